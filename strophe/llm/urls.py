"""URL filters with redirect equivalence.

Every URL is judged by host and path rules. URLs that a redirect or a canonical link joins are one
resource: connected components over these edges carry a block to every alias without a rule of its own.
An own rule always stands, and an allow rule on any alias of a component precedes blocks on others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import frames
from strophe.llm.graph import connected_components
from strophe.llm.store import Workspace

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, null if none does; of equal ones the first."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):  # the last one built in decides
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(found)
    return found


def node_of(url: Column) -> Column:
    """The resource a URL names: without fragment, scheme and host in lower case, an empty path as /."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"(?s)^([^/?]*?://[^/?]*)", 1))
    tail = F.substr(bare, F.length(head) + 1)
    return F.when(head != "", F.concat(head, F.when(tail == "", "/").otherwise(tail)))


def _resolve(base: Column, href: Column) -> Column:
    root = F.regexp_extract(base, r"(?s)^([^/?#]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([^/?#:]*:)//", 1)
    folder = F.regexp_extract(base, r"(?s)^([^?#]*/)[^/?#]*(?:[?#].*)?$", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(folder, href))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) of the canonical links and refresh redirects in pages (url, html)."""
    tags = pages.where("url is not null and html is not null").where(F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    canonical = F.col("tag").rlike(r"(?i)^<link\b") & F.col("tag").rlike(r"(?i)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b")
    refresh = F.col("tag").rlike(r"(?i)^<meta\b") & F.col("tag").rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b")
    href = F.regexp_extract("tag", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    to = F.regexp_extract("tag", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    found = tags.select("url", F.when(canonical, href).when(refresh, to).alias("href")).where("href <> ''")
    edges = found.select(node_of(F.col("url")).alias("src"), node_of(_resolve(F.col("url"), F.regexp_replace("href", "&amp;", "&"))).alias("dst"))
    return edges.where("src <> dst")


def judge_urls(spark: SparkSession, pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """One row per row of pages: page_id, url, host, path, rule (null if none fits), verdict.

    pages has page_id, url and html; redirects, if given, has src_url and dst_url. Null URLs and URLs
    without :// have empty host and path and no alias, and get the default. Of rules of equal length the first counts.
    Repeated rows are each judged; other columns are not read.
    """
    work = Workspace(spark, "urls")
    pages = frames.pick(pages, "page_id", "url", "html")
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("src_url")).alias("src"), node_of(F.col("dst_url")).alias("dst")).where("src <> dst"))
    groups = connected_components(work, edges)
    judged = groups.withColumn("m", matched(host_of(F.col("node")), path_of(F.col("node")), rules).getField("verdict"))
    says = judged.groupBy("component").agg(F.max(F.when(F.col("m") == "allow", 2).when(F.col("m") == "block", 1).otherwise(0)).alias("says"))
    alias = work.save(groups.join(says.where("says > 0"), "component").select("node", F.when(F.col("says") == 2, "allow").otherwise("block").alias("by_alias")))
    own = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumn("m", matched(F.col("host"), F.col("path"), rules))
    out = own.join(alias, node_of(F.col("url")) == F.col("node"), "left")
    return out.select("page_id", "url", "host", "path", F.col("m.rule").alias("rule"), F.coalesce(F.col("m.verdict"), "by_alias", F.lit(default)).alias("verdict"))
