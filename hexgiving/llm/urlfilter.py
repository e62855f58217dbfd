"""URL rules with redirect equivalence: decisions reach the aliases of a url. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexgiving.llm.common import stored
from hexgiving.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# canonical as any word of rel
REL = r"\brel\s*=\s*(?:[\"']?|\"[^\">]*\s|'[^'>]*\s)canonical\b"
CANONICAL = rf"(?i)<link\b[^>]*{REL}[^>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
# the whole tag, then its last url: attributes come in any order
REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*"
URL = r"(?is)^.*\burl\s*=\s*[\"']?([^\"'\s>]+)"


def url_columns(url: Column) -> dict[str, Column]:
    """host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: then up to ``? #``;
    node: host, path and query, the url's identity (null without ``://``)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)
    return {"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit("")),
            "node": F.concat(host, path, query)}


def rules_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """(host, path, action) rows from (``host/path``, action) pairs."""
    rows = [(r[:r.index("/")].lower(), r[r.index("/"):], action) for r, action in rules]
    return spark.createDataFrame(rows, "host string, path string, action string")


def link_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(a, b, host, path): each page's url, and the canonical link or refresh target its html declares."""
    html, here = F.col(html_col), url_columns(F.col(url_col))
    declared = F.array(F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1),
                       F.regexp_extract(F.regexp_extract(html, REFRESH, 0), URL, 1))
    to = (pages.where(html.rlike(rf"(?i){REL}|http-equiv\s*=\s*[\"']?refresh"))
          .select(*(c.alias(k) for k, c in here.items()), F.explode(declared).alias("href"))
          .where("href != '' AND node IS NOT NULL").withColumn("href", F.replace("href", F.lit("&amp;"), F.lit("&"))))
    target = (F.when(F.col("href").contains("://"), F.col("href"))
              .when(F.col("href").startswith("//"), F.concat(F.lit(":"), F.col("href")))
              .when(F.col("href").startswith("/"), F.concat(F.lit("://"), "host", "href"))
              .otherwise(F.concat(F.lit("://"), "host", F.regexp_replace("path", r"[^/]*$", ""), "href")))
    there = url_columns(F.col("target"))
    return (to.withColumn("target", target)
            .select(F.col("node").alias("a"), there["node"].alias("b"), F.col("host").alias("host_a"),
                    F.col("path").alias("path_a"), there["host"].alias("host_b"), there["path"].alias("path_b"))
            .distinct())


def matched_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action) for the distinct (host, path) of ``urls`` that a rule fits; the longest wins.

    Equi-joins only: each host's suffixes meet the rule hosts and bring the
    path lengths worth trying, then (suffix, path prefix) meets the rules. So
    a host with many pages and many rules costs pages times distinct rule
    lengths. Of rules with one host and path, allow wins.
    """
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.min("action").alias("action"))
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = (urls.select("host", "path").where("host != ''").distinct()
             .select("host", "path", F.explode(suffixes).alias("rule_host"))
             .join(lengths.withColumnRenamed("host", "rule_host"), "rule_host")
             .select("host", "path", "rule_host", F.explode("lengths").alias("n"))
             .where(F.length("path") >= F.col("n"))
             .withColumn("rule_path", F.expr("substring(path, 1, n)")))
    fits = tried.join(rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action"),
                      ["rule_host", "rule_path"])
    rule = F.concat("rule_host", "rule_path")
    best = F.max_by(F.struct(rule.alias("rule"), "action"), F.struct(F.length(rule), rule))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.action")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: id, host, path, rule, verdict, by_alias.

    A page's own longest rule decides. Without one, its equivalence class
    does: the urls connected by canonical links and refreshes, pages or not.
    An explicitly allowed member allows the class, else a blocked member
    blocks it; else allow. Null url or one without ``://``: empty host and
    path, no rule, no class, allow. Null html has no links. Equal urls (but
    for scheme and fragment) share a verdict; repeated rows are judged alike.
    Other columns are not read.
    """
    links = stored(link_edges(pages, url_col, html_col).where("b IS NOT NULL"), "links")
    here = url_columns(F.col(url_col))
    page = pages.select(F.col(id_col).alias("id"), *(c.alias(k) for k, c in here.items()))
    ends = links.select(F.col("a").alias("node"), F.col("host_a").alias("host"), F.col("path_a").alias("path")).union(
        links.select("b", "host_b", "path_b")).distinct()
    decided = stored(matched_rules(page.select("host", "path").unionByName(ends.select("host", "path")), rules), "rules")
    parts = connected_components(links)
    member = (ends.join(decided, ["host", "path"], "left").join(parts, "node", "left")
              .withColumn("c", F.coalesce("component", "node")))
    # 'allow' sorts before 'block': the smallest action is the class's
    by_class = member.groupBy("c").agg(F.min("action").alias("alias_action")).where("alias_action IS NOT NULL")
    alias = member.select("node", "c").distinct().join(by_class, "c").select("node", "alias_action")
    out = page.join(decided, ["host", "path"], "left").join(alias, "node", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule",
                      F.coalesce("action", "alias_action", F.lit("allow")).alias("verdict"),
                      F.expr("action IS NULL AND alias_action IS NOT NULL").alias("by_alias"))
