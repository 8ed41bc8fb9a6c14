"""Genomic interval overlap and set enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadic.functions.tails import clean_nan, hypergeom_upper_udf
from dyadic.operators.ranking import bh_fdr, largest_group, ordered_prefix, top_n
from dyadic.session import TASK_ROWS, materialize, small_side

# Keyword lists per theme, matched inside lower-cased terms.
KEYWORDS = {
    "monocyte": ("monocyte", "mononuclear", "macrophage", "myeloid"),
    "inflammatory": ("inflammatory", "inflammation", "cytokine", "interleukin", "nfkb", "nf-kb", "tnf", "interferon",
                     "immune", "innate immunity"),
    "wnt": ("wnt", "wingless", "frizzled", "beta-catenin"),
    "cd8t": ("t cell", "cytotoxic", "adaptive immunity", "lymphocyte", "cd8"),
    "stress_trauma": ("stress", "glucocorticoid", "cortisol", "hpa axis", "ptsd"),
    "epigenetic": ("methylation", "chromatin", "histone", "epigenetic"),
}
# Themes any one of which makes a result coherent.
CORE_THEMES = ("monocyte", "inflammatory", "wnt")


def ids_to_intervals(ids: DataFrame, manifest: DataFrame) -> DataFrame:
    """1-bp interval per known id; `manifest(feature_id, chrom, position)`, chr prefix added if absent."""
    chrom = F.col("chrom").cast("string")
    start = F.col("position").cast("bigint")
    return ids.join(manifest, "feature_id").select(
        *ids.columns,
        F.when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom)).alias("chrom"),
        start.alias("start"), (start + 1).alias("end"),
    )


def merge_intervals(intervals: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Disjoint cover of the intervals of each (set_name, chrom); touching ones are joined."""
    keys = ["set_name", "chrom"]
    longest = materialize(
        intervals.filter(F.col("end") >= F.col("start")).groupBy(*keys, "start").agg(F.max("end").alias("end"))
    )
    how = {"task_rows": task_rows, "largest": largest_group(longest, keys)}
    placed = materialize(ordered_prefix(
        longest.withColumn("_one", F.lit(1)), keys, "start", {"_reach": ("max", "end"), "_at": ("count", "_one")}, **how
    ))
    # The largest end before a start is the running maximum one place earlier.
    ahead = placed.select(*keys, (F.col("_at") + 1).alias("_at"), F.col("_reach").alias("_before"))
    flagged = placed.join(ahead, [*keys, "_at"], "left").withColumn(
        "_opens", F.when(F.col("_before") >= F.col("start"), 0).otherwise(1)
    )
    islands = ordered_prefix(flagged, keys, "start", {"_island": ("count", "_opens")}, **how)
    return islands.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def _nodes_of_interval(low: str, high: str, top: int) -> Column:
    """The fewest dyadic blocks (level, node) that make up the whole numbers from `low` up to, without, `high`.

    A block of level k, up to `top`, is `node * 2^k` to `(node + 1) * 2^k - 1`. At each level an interval has at most a block at either
    end that is no half of a larger one inside it, so it has at most two per level, however long it is.
    """
    first, last = f"shiftright({low} + shiftleft(1L, k) - 1L, k)", f"shiftright({high}, k)"
    block = "if({first} < {last} and {node} % 2 = {odd}, struct(k as level, {node} as node), null)"
    ends = ", ".join(block.format(first=first, last=last, node=node, odd=odd) for node, odd in ((first, 1), (f"({last} - 1L)", 0)))
    return F.expr(f"filter(flatten(transform(sequence(0, {top}), k -> array({ends}))), b -> b is not null)")


def _nodes_of_point(at: str, levels: range) -> Column:
    """The blocks of the given levels that hold the whole number `at`."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.expr(f"shiftright({at}, {k})").alias("node")) for k in levels])


def overlap_spots(queries: DataFrame, targets: DataFrame, closed: bool = False, task_rows: int = TASK_ROWS) -> DataFrame:
    """(chrom, start, end, set_name) of every distinct query place that meets a target interval of the set.

    Two intervals meet if one holds the start of the other. Starts are looked up in intervals cut to dyadic blocks, by
    equality of chromosome and block: an interval is at most two rows per level of a binary tree over the coordinates, a
    start one row per level in use, so no row count depends on an interval's length and there is no width to choose. Equal
    query places are joined once. Targets are merged to a disjoint cover first, so a start lies in one of a set at most, and
    starts of a set in the same block count as one. `closed` counts shared end points as overlap; the default is half-open.
    Coordinates are whole numbers; intervals that end before they start, and null coordinates, meet nothing.
    """
    whole = [F.col("start").cast("bigint").alias("_s"), F.col("end").cast("bigint").alias("_e")]
    spots = materialize(queries.select("chrom", "start", "end").distinct().select("chrom", "start", "end", *whole).filter("_e >= _s"))
    cover = materialize(merge_intervals(targets.select("set_name", "chrom", "start", "end"), task_rows).select("set_name", "chrom", *whole))
    length = F.max(F.col("_e") - F.col("_s"))
    (first, wide), (low, broad) = (df.agg(F.min("_s"), length).first() for df in (spots, cover))
    if first is None or low is None:
        return spots.select("chrom", "start", "end", F.lit(None).cast(targets.schema["set_name"].dataType).alias("set_name")).limit(0)
    zero, extra = min(first, low), int(closed)
    spots, cover = (df.withColumns({"_s": F.col("_s") - F.lit(zero), "_e": F.col("_e") - F.lit(zero) + extra}) for df in (spots, cover))

    def blocks(df: DataFrame, top: int) -> DataFrame:
        return df.withColumn("_b", F.explode(_nodes_of_interval("_s", "_e", top))).select(
            *df.columns, F.col("_b.level").alias("_k"), F.col("_b.node").alias("_node"))

    def starts(df: DataFrame, top: int) -> DataFrame:
        return df.withColumn("_b", F.explode(_nodes_of_point("_s", range(top + 1)))).select(
            *df.columns, F.col("_b.level").alias("_k"), F.col("_b.node").alias("_node"))

    # No block is longer than the longest interval, so a start has a row for each level up to that.
    broad, wide = (max(n + extra, 1).bit_length() - 1 for n in (broad, wide))
    held = blocks(cover, broad).select("set_name", "chrom", "_k", "_node", F.col("_s").alias("_ts"), F.col("_e").alias("_te"))
    inside = starts(spots, broad).join(small_side(held), ["chrom", "_k", "_node"]).filter("_ts < _e and _te > _s")
    # The furthest end among a set's starts in a block says whether one of its targets reaches past the query's start.
    far = starts(cover, wide).groupBy("set_name", "chrom", "_k", "_node").agg(F.max("_e").alias("_te"))
    around = blocks(spots, wide).join(small_side(far), ["chrom", "_k", "_node"]).filter("_te > _s")
    where = ["chrom", "start", "end", "set_name"]
    return inside.select(*where).unionByName(around.select(*where)).distinct()


def overlap_members(
    queries: DataFrame, targets: DataFrame, query_id: str = "feature_id", closed: bool = False, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """(query_id, set_name) for every query interval that meets a target interval of the set."""
    hit = overlap_spots(queries, targets, closed, task_rows)
    return queries.select(query_id, "chrom", "start", "end").join(hit, ["chrom", "start", "end"]).select(query_id, "set_name")


def hypergeom_table(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Add expected, enrichment, p_val and q_val to (n_sig, n_background, n_feature, observed) rows.

    An empty background or set gives NULLs. q-values run over all rows, or within `by`.
    """
    zero = F.lit(0).cast("bigint")
    valid = (F.col("n_background") > 0) & (F.col("n_feature") > 0)
    expected = F.when(valid, F.col("n_sig") * (F.col("n_feature") / F.nullif(F.col("n_background"), zero)))
    p = F.when(valid, clean_nan(hypergeom_upper_udf("observed", "n_background", "n_feature", "n_sig")))
    scored = counts.withColumn("expected", F.coalesce(expected, F.lit(0.0))).withColumn(
        "enrichment", F.when(valid, F.col("observed") / F.nullif(F.col("expected"), F.lit(0.0)))
    ).withColumn("p_val", p)
    return bh_fdr(scored, by or [])


def regulatory_enrichment(
    results: DataFrame, positions: DataFrame, background: DataFrame, targets: DataFrame, fdr: float = 0.05,
    closed: bool = False,
) -> DataFrame:
    """Hypergeometric enrichment of each cell type's significant features in each interval set.

    Places are matched with the sets once, for the background and all cell types together.
    """
    place = ["chrom", "start", "end"]
    places = positions.select(*place).unionByName(background.select(*place))
    spots = materialize(overlap_spots(places, targets, closed))
    n_background = background.agg(F.count(F.lit(1))).scalar()
    sizes = background.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).join(spots, place).groupBy("set_name").agg(
        F.sum("_n").alias("n_feature"))
    hits = results.filter(F.col("q_val") < fdr).select("cell_type", "feature_id").join(
        positions.select("feature_id", *place), "feature_id")
    n_sig = hits.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n_sig"))
    seen = hits.groupBy("cell_type", *place).agg(F.count(F.lit(1)).alias("_n")).join(spots, place).groupBy(
        "cell_type", "set_name").agg(F.sum("_n").alias("observed"))
    sets = targets.select("set_name").distinct().join(sizes, "set_name", "left").na.fill(0, subset=["n_feature"])
    # Every (cell type, set) pair is a result row.
    grid = n_sig.crossJoin(small_side(sets))
    counts = grid.join(seen, ["cell_type", "set_name"], "left").na.fill(0, subset=["observed"])
    return hypergeom_table(counts.withColumn("n_background", n_background)).select(
        "cell_type", "set_name", "n_sig", "n_background", "n_feature", "observed", "expected", "enrichment", "p_val", "q_val"
    )


def annotate_explode(features: DataFrame, annotation: DataFrame, first: str = "gene", second: str = "fallback",
                     sep: str = ";") -> DataFrame:
    """Distinct (row, gene) pairs: genes of the first column, or of the second where the first is empty or NA."""
    def present(name: str) -> Column:
        text = F.trim(F.col(name).cast("string"))
        return F.when(text.isin("", "NA", "nan", "None"), F.lit(None)).otherwise(text)

    genes = F.split(F.coalesce(present(first), present(second)), sep)
    return (
        features.join(annotation, "feature_id")
        .select(*[c for c in features.columns if c != "feature_id"], F.explode(genes).alias("gene_id"))
        .withColumn("gene_id", F.trim("gene_id"))
        .filter(F.col("gene_id") != "")
        .distinct()
    )


def over_representation(
    lists: DataFrame, gene_sets: DataFrame, n_background: int | None = None, min_genes: int = 5
) -> DataFrame:
    """Enrichment of `lists(cell_type, gene_id)` in `gene_sets(library, term, gene_id)`.

    Lists with fewer than `min_genes` genes are left out. The background is each
    library's gene universe unless a size is given. q-values per cell type and library.
    """
    genes = lists.select("cell_type", "gene_id").distinct()
    sized = genes.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n_input")).filter(F.col("n_input") >= min_genes)
    genes = genes.join(sized.select("cell_type"), "cell_type", "left_semi")
    sets = gene_sets.select("library", "term", "gene_id").distinct()
    terms = sets.groupBy("library", "term").agg(F.count(F.lit(1)).alias("n_feature"))
    universe = sets.groupBy("library").agg(F.countDistinct("gene_id").alias("n_background"))
    if n_background is not None:
        universe = universe.withColumn("n_background", F.lit(n_background).cast("bigint"))
    in_library = genes.join(sets.select("library", "gene_id").distinct(), "gene_id").groupBy("cell_type", "library").agg(
        F.count(F.lit(1)).alias("n_sig")
    )
    seen = genes.join(sets, "gene_id").groupBy("cell_type", "library", "term").agg(F.count(F.lit(1)).alias("observed"))
    counts = seen.join(terms, ["library", "term"]).join(small_side(universe), "library").join(
        in_library, ["cell_type", "library"])
    return hypergeom_table(counts, ["cell_type", "library"])


def keyword_hits(terms: DataFrame, by: list[str], term: str = "term", adj_p: str = "q_val", cut: float = 0.05,
                 order: list[Column] | None = None, shown: int = 3, keywords: dict = KEYWORDS,
                 extra: list[str] | None = None) -> DataFrame:
    """First matching significant terms per group and theme; `extra` columns are carried along."""
    text = F.lower(F.col(term))
    themes = F.array(*[F.when(contains_any(text, words), F.lit(name)) for name, words in keywords.items()])
    tagged = terms.filter(F.coalesce(F.col(adj_p), F.lit(1.0)) < cut).select(
        *by, text.alias(term), adj_p, *(extra or []), F.explode(F.filter(themes, lambda x: x.isNotNull())).alias("theme")
    )
    return top_n(tagged, [*by, "theme"], order or [F.col(adj_p), F.col(term)], shown)


def contains_any(text: Column, words) -> Column:
    """True if the text contains any of the words."""
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def coherence(hits: DataFrame, by: list[str], core=CORE_THEMES) -> DataFrame:
    """Coherent if two themes are hit, or any core theme."""
    return hits.groupBy(*by).agg(F.countDistinct("theme").alias("n_themes"), F.max(F.col("theme").isin(*core)).alias("_core")).select(
        *by, "n_themes", ((F.col("n_themes") >= 2) | F.col("_core")).alias("coherent")
    )
