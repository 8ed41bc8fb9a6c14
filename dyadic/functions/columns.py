"""Scalar column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Visit spellings.
PRE_LABELS = ("PRE", "PRE_IOP", "PRE-IOP", "BL", "BASELINE")
POST_LABELS = ("POST", "POST_IOP", "POST-IOP", "12W", "WEEK12")
# Wider spellings used by the second cohort and by the expression tables.
PRE_LABELS_WIDE = PRE_LABELS + ("T0", "0")
POST_LABELS_WIDE = POST_LABELS + ("12WEEKS", "T1", "1")
# Response spellings.
RESPONDER_LABELS = ("R", "RESPONDER", "1")
NONRESPONDER_LABELS = ("NR", "NON-RESPONDER", "0")
BASELINE_GROUP_LABELS = (("R_BL",), ("NR_BL",))
# Regulator families of interest.
FAMILIES = {
    "NFAT": ("NFATC1", "NFATC2", "NFATC3", "NFATC4", "NFAT5"),
    "WNT": ("TCF7L2", "LEF1", "TCF7", "TCF7L1"),
}


def finite_or_null(col: Column) -> Column:
    """NaN and infinities to NULL."""
    col = col.cast("double")
    return F.when(F.isnan(col) | (F.abs(col) == F.lit(float("inf"))), F.lit(None)).otherwise(col)


def normalise_visit(col: Column, pre=PRE_LABELS, post=POST_LABELS, strict: bool = True) -> Column:
    """Map a visit spelling to PRE or POST; an unknown one raises (or is NULL if not strict)."""
    token = F.upper(F.trim(col.cast("string")))
    known = F.when(token.isin(*pre), "PRE").when(token.isin(*post), "POST")
    if not strict:
        return known
    return known.otherwise(F.raise_error(F.concat(F.lit("unrecognised visit label: "), F.coalesce(token, F.lit("NULL")))))


def encode_response(col: Column, yes=RESPONDER_LABELS, no=NONRESPONDER_LABELS) -> Column:
    """1 for responder spellings, 0 for non-responder ones, NULL otherwise."""
    token = F.upper(F.trim(col.cast("string")))
    return F.when(token.isin(*yes), F.lit(1)).when(token.isin(*no), F.lit(0))


def response_name(code: Column) -> Column:
    """Numeric response codes 1, 2, 3 to R, NR, NA."""
    return F.when(code == 1, "R").when(code == 2, "NR").when(code == 3, "NA")


def logit2(beta: Column, clip: float = 1e-6, m_clip: float | None = None) -> Column:
    """log2(b / (1 - b)) with the fraction clipped to [clip, 1 - clip] and the result to +-m_clip."""
    b = F.greatest(F.lit(clip), F.least(F.lit(1.0 - clip), beta))
    m = F.when(beta.isNotNull(), F.log2(b / (F.lit(1.0) - b)))
    return m if m_clip is None else F.when(m.isNotNull(), F.greatest(F.lit(-m_clip), F.least(F.lit(m_clip), m)))


def safe_ratio(num: Column, parts: list[Column], fallback: Column | None = None) -> Column:
    """num / sum(parts), NULL parts counting as zero; NULL on a zero sum, then the fallback."""
    total = F.lit(0.0)
    for part in parts:
        total = total + F.coalesce(part, F.lit(0.0))
    ratio = num / F.nullif(total, F.lit(0.0))
    return ratio if fallback is None else F.coalesce(ratio, fallback)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def literal_vector(values) -> Column:
    """Constant array<double>, parsed in one step (a literal per entry is slow to build)."""
    def text(v: float) -> str:
        return f"{v!r}D" if v == v and abs(v) != float("inf") else f"CAST('{v}' AS DOUBLE)"

    return F.expr("array(" + ", ".join(text(float(v)) for v in values) + ")")


def vector_aggregate(function: str, vector: str, d: int) -> Column:
    """Array of one aggregate per component of an array column of known width."""
    return F.expr("array(" + ", ".join(f"{function}(`{vector}`[{i}])" for i in range(d)) + ")")


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit_vector(a: Column) -> Column:
    """a / |a|; vectors shorter than 1e-12 are left as they are."""
    length = norm(a)
    return F.transform(a, lambda x: x / F.when(length < 1e-12, F.lit(1.0)).otherwise(length))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def arc_length(a: Column, b: Column) -> Column:
    """Angle between two unit vectors."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def odds(p: Column, clip: float | None = 1e-6, floor: float | None = None) -> Column:
    """p / (1 - p), with p clipped or with a floor under the denominator."""
    if floor is not None:
        return p / F.greatest(F.lit(1.0) - p, F.lit(floor))
    q = F.greatest(F.lit(clip), F.least(F.lit(1.0 - clip), p))
    return q / (F.lit(1.0) - q)


def symbol_of(feature: Column) -> Column:
    """`ENSG..._SYMBOL` to SYMBOL; anything else unchanged."""
    hit = F.regexp_extract(feature, r"(?s)^ENSG[^_]*_(.*)$", 1)
    return F.when(feature.rlike(r"(?s)^ENSG[^_]*_"), hit).otherwise(feature)


def family_label(name: Column, families: dict = FAMILIES) -> Column:
    """Family whose member list holds the name, else the empty string."""
    out = F.lit("")
    for label, members in families.items():
        out = F.when(name.isin(*members), label).otherwise(out)
    return out


def same_sign(a: Column, b: Column) -> Column:
    """Equal signs; false when either is missing."""
    return F.coalesce(F.signum(a) == F.signum(b), F.lit(False))


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


# The published PPND16 rational approximation of the normal quantile.
PPND_CENTRE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
     45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
     21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
PPND_MIDDLE = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
     1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
     0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9),
)
PPND_FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
     0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
     0.000786869131145613259100, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function for p in (0, 1)."""
    q = p - 0.5
    r = F.lit(0.180625) - q * q
    centre = q * _horner(r, PPND_CENTRE[0]) / _horner(r, PPND_CENTRE[1])
    t = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    middle = _horner(t - 1.6, PPND_MIDDLE[0]) / _horner(t - 1.6, PPND_MIDDLE[1])
    far = _horner(t - 5.0, PPND_FAR[0]) / _horner(t - 5.0, PPND_FAR[1])
    tail = F.when(t <= 5.0, middle).otherwise(far)
    return F.when(F.abs(q) <= 0.425, centre).otherwise(F.when(q < 0, -tail).otherwise(tail))
