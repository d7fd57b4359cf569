"""URL filters whose block decisions spread over redirects and canonical links.

Rules are matched first: a rule fits its host and all subdomains if the path starts with the rule's path; of several
the longest wins, and between equally long ones allow wins. Redirects, canonical links and meta refreshes join URLs
into components (distributed, see components.py); a URL without a rule of its own is blocked if any URL of its
component is blocked by a rule. A URL's own allow rule always takes precedence.

Nulls: a null URL, or one without `://`, has an empty host and path, no rule and no aliases, and is allowed. Null
HTML has no links. Rows that repeat a page or URL are each judged. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"(?is)<link\b[^>]*?\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"

#: The rules of the registered query: verdict, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The URL as a node: scheme and host in lower case, no fragment; null without a scheme."""
    at = F.instr(url, "://")
    rest = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(at > 0, F.concat(F.translate(F.substring(url, F.lit(1), at + 2), _UPPER, _LOWER), host_of(url), F.when(rest == "", "/").otherwise(rest)))


def _resolve(base: Column, link: Column) -> Column:
    """The link against its page's URL."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    scheme = F.substring_index(base, "://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_extract(path_of(base), r"^(?:.*/)?", 0)
    return (
        F.when(F.coalesce(link, F.lit("")) == "", None).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(site, link))
        .when(link.rlike(r"^[#?]"), F.concat(site, path_of(base), link)).otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), link))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Canonical and refresh links of pages that have them: src, dst."""
    low = F.lower(pages[html])
    with_links = pages.where(low.contains("canonical") | low.contains("refresh")).select(pages[url].alias("u"), pages[html].alias("t"))
    href = F.regexp_extract(F.regexp_extract("t", _CANONICAL, 0), r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    meta = F.regexp_extract(F.regexp_extract("t", _REFRESH, 0), r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    return with_links.select("u", F.explode(F.array(href, meta)).alias("l")).where("l <> ''").select(F.col("u").alias("src"), _resolve(F.col("u"), F.col("l")).alias("dst"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path, ...) and rules (verdict, host, path): each (host, path) with its rule and verdict, or nulls.

    Hosts are exploded into their suffixes and joined with the rules by equality; Spark broadcasts the rules only
    where they are small.
    """
    sites = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.select(F.col("host").alias("suffix"), F.col("path").alias("rule_path"), F.col("verdict").alias("v")).distinct()
    hits = sites.withColumn("suffix", F.explode(suffixes)).join(r, "suffix").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("suffix", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("v") == "allow").alias("a"), rule.alias("rule"), F.col("v").alias("verdict")))
    return hits.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")


def judge_pages(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, url: str = "url", html: str | None = "html") -> DataFrame:
    """pages with `_host`, `_path`, `_rule`, `_verdict`, `_aliased` (an alias's block decided); columns of pages that are called so give way.

    redirects (src, dst) are further edges, such as a crawler's redirect log.
    """
    edges = page_links(pages, url, html) if html else None
    if redirects is not None:
        edges = redirects.select("src", "dst") if edges is None else edges.unionByName(redirects.select("src", "dst"))
    whole = F.struct(*[pages[c] for c in pages.columns if c.lower() not in ("_host", "_path", "_rule", "_verdict", "_aliased")]).alias("_page")
    sites = pages.select(host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    if edges is not None:
        edges = cut(edges)
        links = cut(edges.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct())
        ends = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        sites = sites.union(ends.select(host_of(F.col("node")), path_of(F.col("node"))))
    ruled = cut(match_rules(sites, rules))
    out = pages.select(whole, host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"), node_of(pages[url]).alias("node")).join(ruled, ["host", "path"], "left")
    if edges is not None:
        member = components(links)
        member = cut(ends.join(member, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
        blocked = (
            member.select("component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
            .join(ruled.where("verdict = 'block'"), ["host", "path"], "left_semi").select("component").distinct()
        )
        spread = cut(member.join(blocked, "component", "left_semi").select("node", F.lit(True).alias("spread")))
        out = out.join(spread, "node", "left")
    else:
        out = out.withColumn("spread", F.lit(None).cast("boolean"))
    aliased = F.col("verdict").isNull() & F.coalesce("spread", F.lit(False))
    return out.select("_page.*", F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("rule").alias("_rule"), F.coalesce("verdict", F.when(aliased, "block").otherwise("allow")).alias("_verdict"), aliased.alias("_aliased"))


def op10(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    judged = judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
    return judged.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))
