"""Judge URLs by host and path rules, and carry blocks over to aliases: pages joined by redirects or canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadic.llm.graph import connected_components
from dyadic.session import materialize

# (verdict, host, path)
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
# Pages whose tags are looked at one by one.
_WORTH = r"(?i)canonical|http-equiv"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` and for null."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(verdict, rule) of the longest rule whose host is `host` or a parent domain and whose path starts `path`, else null.

    Of rules equally long in host and path together, the one with the longer host wins.
    """
    found = None
    for verdict, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]))):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        then = F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))
        found = F.when(fits, then) if found is None else found.when(fits, then)
    return found


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, its `.` and `..` steps taken; none goes above the root."""
    steps = F.split(F.regexp_replace(path, r"/(\.\.?)$", "/$1/"), "/")
    taken = F.aggregate(
        F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))), F.lit(""),
        lambda done, step: F.when(step == ".", done).when(step == "..", F.regexp_replace(done, "/[^/]*$", ""))
        .otherwise(F.concat(done, F.lit("/"), step)))
    return F.when(path.rlike(r"/\.\.?(/|$)"), taken).otherwise(path)


def node_of(url: Column) -> Column:
    """The page a URL names: host, path without dot steps, and query; no scheme or fragment. Null for no absolute URL."""
    path, query = path_of(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*([^#]*)", 1)
    host = host_of(url)
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(host != "", F.concat(host, without_dots(rooted), query))


def _absolute(link: Column, base: Column) -> Column:
    """A link of a page as an absolute URL: whole, scheme-relative, host-relative, query-only, or beside the page."""
    scheme = F.regexp_extract(base, r"^([^:/?#]*)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*(/(?:[^?#]*/)?)", 1)
    return (
        F.when(F.col("_link").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(page, link))
        .when((link == "") | link.startswith("#"), base)
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), link))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): nodes of pages (url, html) and of the pages they declare as canonical or redirect to at once."""
    tags = pages.filter(F.col("html").rlike(_WORTH) & F.col("url").isNotNull()).select(
        "url", F.explode(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))).alias("tag"))
    value = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def attribute(name: str) -> Column:
        return F.concat(*[F.regexp_extract("tag", rf"(?is)\s{name}{value}", g) for g in (1, 2, 3)])

    canonical = F.lower(attribute("rel")).rlike(r"(^|\s)canonical(\s|$)")
    refresh = F.lower(attribute("http-equiv")) == "refresh"
    target = F.regexp_extract(attribute("content"), r"""(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*['"]?([^'"]*)""", 1)
    linked = tags.select("url", F.trim(F.regexp_replace(F.when(canonical, attribute("href")).when(refresh, target), "&amp;", "&")).alias("_link"))
    linked = linked.filter("_link is not null and _link <> ''")
    return linked.select(node_of(F.col("url")).alias("a"), node_of(_absolute(F.col("_link"), F.col("url"))).alias("b")).filter(
        "a is not null and b is not null")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Per row of `pages` (page_id, url, html): page_id, host, path, rule, verdict, and the alias group's `group`.

    A page's own rule decides, so an explicit allow stands against any block of its aliases. A page without a rule is
    blocked if some page of its component in the graph of redirects and canonical links has a block rule - linked pages
    outside the table included - and allowed otherwise. `redirects` (source, target) adds observed redirects of URLs.

    Null URLs and those without `://` have empty host and path, no links and no rule, and are allowed. Null html has no
    links. Repeated rows and repeated URLs stay as they are. An empty table gives an empty result. Other columns are not
    read.
    """
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(
            node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")).filter("a is not null and b is not null"))
    groups = materialize(connected_components(edges))
    asked = F.concat(F.lit("://"), F.col("node"))
    own = rule_for(host_of(asked), path_of(asked), rules)
    blocked = groups.groupBy("root").agg(F.max(own["verdict"] == "block").alias("blocked"))
    aliases = groups.join(blocked, "root").select("node", F.col("root").alias("group"), F.coalesce("blocked", F.lit(False)).alias("blocked"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    # A page without a node has no group; a key of its own, which no node has, keeps such rows from meeting in one task.
    rows = rows.withColumn("node", F.coalesce("node", F.concat(F.lit("#"), F.col("page_id").cast("string"))))
    rows = rows.withColumn("own", rule_for(F.col("host"), F.col("path"), rules)).join(aliases, "node", "left")
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), "group")


def _sql_rules(host: str, path: str, what: str) -> str:
    cases = "".join(
        f" WHEN ({host} = '{name}' OR ends_with({host}, '.{name}')) AND starts_with({path}, '{start}') THEN '{verdict if what == 'verdict' else name + start}'"
        for verdict, name, start in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]))))
    return f"CASE{cases} END"


# Links take all forms; components come from a recursive closure.
_HOST = r"translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_replace('/' || regexp_extract({u}, '(?s)^.*?://[^/?#]*/?([^?#]*)', 1), '/(\.\.?)$', '/\1/')"
_STEPS = rf"list_reduce(string_split({_PATH}, '/'), lambda done, step: CASE WHEN step = '.' THEN done WHEN step = '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || step END)"
_NODE = rf"nullif({_HOST}, '') || {_STEPS} || regexp_extract({{u}}, '(?s)^.*?://[^/?#]*[^?#]*([^#]*)', 1)"
_ATTRIBUTE = r"""regexp_replace(regexp_extract(tag, '(?is)\s{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g')"""
OP10_SQL = rf"""
WITH RECURSIVE tags AS (SELECT url, unnest(regexp_extract_all(html, '{_TAG}')) AS tag FROM pages WHERE url LIKE '%://%'),
links AS (SELECT url, trim(replace(CASE WHEN regexp_matches(lower({_ATTRIBUTE.format(name='rel')}), '(^|\s)canonical(\s|$)') THEN {_ATTRIBUTE.format(name='href')}
  WHEN lower({_ATTRIBUTE.format(name='http-equiv')}) = 'refresh' THEN regexp_extract({_ATTRIBUTE.format(name='content')}, '(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*[''"]?([^''"]*)', 1) END, '&amp;', '&')) AS l FROM tags),
whole AS (SELECT url, CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN l WHEN starts_with(l, '//') THEN 'http:' || l
  WHEN starts_with(l, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || l
  WHEN starts_with(l, '?') THEN regexp_extract(url, '(?s)^(.*?://[^?#]*)', 1) || l WHEN starts_with(l, '#') THEN url
  ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*(/(?:[^?#]*/)?)', 1), ''), '/') || l
  END AS target FROM links WHERE l <> ''),
edges AS (SELECT * FROM (SELECT {_NODE.format(u='url')} AS a, {_NODE.format(u='target')} AS b FROM whole) WHERE a IS NOT NULL AND b IS NOT NULL),
sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a, a AS b FROM sym UNION SELECT r.a, e.b FROM reach r JOIN sym e ON r.b = e.a),
nodes AS (SELECT DISTINCT b AS node, regexp_extract(b, '^([^/]*)', 1) AS h, regexp_extract(b, '^[^/]*([^?]*)', 1) AS p FROM reach),
blocked AS (SELECT a AS node, bool_or(coalesce({_sql_rules('h', 'p', 'verdict')} = 'block', false)) AS blocked, min(b) AS "group" FROM reach JOIN nodes ON reach.b = nodes.node GROUP BY a),
p AS (SELECT page_id, coalesce({_HOST.format(u='url')}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, {_NODE.format(u='url')} AS node FROM pages)
SELECT page_id, host, path, {_sql_rules('host', 'path', 'rule')} AS rule,
  coalesce({_sql_rules('host', 'path', 'verdict')}, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN blocked USING (node)
"""
