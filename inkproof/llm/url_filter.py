"""URL filters with redirect equivalence.

A rule is a host, a path and a verdict; it fits its host and all subdomains where the URL's path
begins with the rule's, and the longest fitting rule (host and path together) decides. Pages that
no rule fits take the verdict of their aliases: URLs joined by redirects or canonical links are
one component, found by distributed connected components; an explicit allow of any alias comes
before a block of another, and without either the page is allowed.

Edges come from the pages' own canonical links and refresh redirects, and from a table of known
redirects if one is given. Alias keys leave out scheme and fragment. Rules are joined on the
hosts' suffixes, so their number isn't bounded by the driver.

A null URL or one without ``://`` has an empty host and path, fits no rule, has no alias and is
allowed. Rows that repeat are judged alike. Of rules with equal host and path an allow wins. Empty
tables give no rows, or no rules. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)"
#: The tags that name another URL: the tag, what it must have, and where the URL stands in it.
TAGS = (
    (r"(?i)<link\b[^>]*>", r"(?i)\brel\s*=\s*[\"']?canonical\b", r"(?i)\bhref\s*=\s*[\"']?([^\"'>\s]+)"),
    (r"(?i)<meta\b[^>]*>", r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b", r"(?i)\burl\s*=\s*[\"']?([^\"'>\s]+)"),
)


def _part(url: Column, k: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, k), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return _part(url, 2)


def alias_key(url: Column) -> Column:
    """Host, path and query; null without a host."""
    key = F.concat(host_of(url), F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url)), _part(url, 3))
    return F.when(host_of(url) != "", key)


def resolve(link: Column, base: Column) -> Column:
    """A link of a page as an absolute URL, read from the page's own; null for a fragment or a scheme other than HTTP."""
    path, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(base), r"(?s)^/(.*/)?", 1))
    beside = F.when(path == "", path_of(base)).when(path.startswith("/"), _undotted(path)).otherwise(_undotted(F.concat(folder, path)))
    return (
        F.when(link.rlike(r"(?i)^https?://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(~link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#|^$") & (host_of(base) != ""), F.concat(F.lit("http://"), host_of(base), beside, rest))
    )


def _undotted(path: Column) -> Column:
    """A path from the root without its segments ``.`` and ``..``; a last one leaves its slash."""
    parts = F.split(F.regexp_replace(path, r"/(\.\.?)$", "/$1/"), "/")
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step), "/"))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` (null where none fits) to rows with ``host`` and ``path``."""
    places = urls.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = places.select("host", "path", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    text = F.concat("rule_host", "rule_path")
    best = near.groupBy("host", "path").agg(F.max(F.struct(F.length(text).alias("n"), (F.col("rule_verdict") == "allow").alias("a"), text.alias("rule"), "rule_verdict")).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(urls["*"], "best.rule", "best.rule_verdict")


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``a, b``: alias keys of pages and of all that they name as canonical or refresh to."""
    url, html = F.col(url_col), F.coalesce(F.col(html_col), F.lit(""))

    def named_in(tag: str, has: str, at: str) -> Column:
        return F.transform(F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda x: x.rlike(has)), lambda x: F.regexp_extract(x, at, 1))

    found = F.concat(*(named_in(*t) for t in TAGS))
    named = pages.where(html.rlike("(?i)canonical|refresh")).select(url.alias("url"), F.explode(found).alias("link"))
    named = named.select("url", F.replace("link", F.lit("&amp;"), F.lit("&")).alias("link")).where("link <> ''")
    return named.select(alias_key(F.col("url")).alias("a"), alias_key(resolve(F.col("link"), F.col("url"))).alias("b"))


def redirect_links(redirects: DataFrame, from_col: str = "from_url", to_col: str = "to_url") -> DataFrame:
    return redirects.select(alias_key(F.col(from_col)).alias("a"), alias_key(F.col(to_col)).alias("b"))


def _place(key: str) -> list[Column]:
    return [F.regexp_extract(key, r"(?s)^([^/]*)", 1).alias("host"), F.regexp_extract(key, r"(?s)^[^/]*([^?]*)", 1).alias("path")]


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, host, path, rule, verdict`` for each row."""
    edges = page_links(pages, url_col, html_col)
    edges = edges.unionByName(redirect_links(redirects)) if redirects is not None else edges
    linked = connected_components(edges)
    ruled = match(linked.select("node", "component", *_place("node")), rules)
    verdicts = ruled.groupBy("component").agg(F.bool_or(F.col("rule_verdict") == "allow").alias("allow"), F.bool_or(F.col("rule_verdict") == "block").alias("block"))
    alias = materialise(linked.join(verdicts, "component").where("block and not coalesce(allow, false)").select("node").distinct())
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), alias_key(url).alias("key"))
    judged = match(rows, rules).join(alias.withColumn("blocked", F.lit(True)), F.col("key") == F.col("node"), "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("id", "host", "path", "rule", verdict.alias("verdict"))
