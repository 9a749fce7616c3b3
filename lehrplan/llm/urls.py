"""URL rules that follow redirects and canonical links.

A rule names a host and a path; it fits the host and its subdomains where the path starts with
the rule's, and the longest fitting rule decides. Addresses that redirect to each other or name
each other as canonical are one component; an address without a rule of its own is blocked if
its component holds a blocked one and none that a rule allows.

Only DataFrame operations: hosts are joined to rules by their suffixes, and components come from
joins over staged edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lehrplan.llm.components import components
from lehrplan.sources.staging import stage

ALLOW, BLOCK = "allow", "block"
Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                  "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules],
                                 "rule_verdict string, rule_host string, rule_path string")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``id, rule, verdict`` for rows of ``urls`` (id, host, path) that a rule fits.

    ``rules`` (rule_verdict, rule_host, rule_path) may be of any size: every suffix of a host is
    looked up, so nothing is compared with all rules. Of equally long rules one that allows wins.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    tried = urls.where("host <> ''").select("id", "path", F.explode(suffixes).alias("rule_host"))
    fits = tried.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    text = F.concat("rule_host", "rule_path")
    best = fits.groupBy("id").agg(F.max(F.struct(
        F.length(text).alias("long"), (F.col("rule_verdict") == ALLOW).alias("allow"),
        text.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best"))
    return best.select("id", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def link_targets(html: Column) -> Column:
    """Array of addresses that a page names as canonical or refreshes to, as written."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    quoted = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def value(tag: Column, name: str) -> Column:
        pattern = rf"(?is)\s{name}{quoted}"
        return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])

    canonical = F.transform(F.filter(tags, lambda t: F.lower(value(t, "rel")) == "canonical"),
                            lambda t: value(t, "href"))
    refresh = F.transform(
        F.filter(tags, lambda t: F.lower(value(t, "http-equiv")) == "refresh"),
        lambda t: F.regexp_extract(value(t, "content"), r"(?is)^[^;,]*[;,]\s*url\s*=\s*['\"]?([^'\"]*)", 1))
    found = F.transform(F.concat(canonical, refresh),
                        lambda t: F.replace(F.trim(t), F.lit("&amp;"), F.lit("&")))
    return F.coalesce(F.filter(found, lambda t: t != ""), F.array().cast("array<string>"))


def resolved(target: Column, base: Column) -> Column:
    """An address as written on the page ``base``, made absolute."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*/)?", 0)
    folder = F.when(folder.endswith("/") & (folder != F.concat(scheme, F.lit("://"))), folder) \
        .otherwise(F.concat(site, F.lit("/")))
    return (F.when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), target)
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(site, target))
            .otherwise(F.concat(folder, target)))


def url_key(url: Column) -> Column:
    """Name of an address: scheme and host in lower case, without its fragment."""
    whole = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*", 0)
    return F.unhex(F.md5(F.concat(F.lower(head), F.substr(whole, F.length(head) + 1)).cast("binary")))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages`` (page_id, url, html).

    Edges are the canonical links and refreshes of the pages and, if given, ``redirects`` (src,
    dst). A null url, or one without ``://``, has an empty host and path, no rule and no
    component; null html has no links. Repeated rows are judged alike, each for itself. Where a
    page without rule has neither block nor allow in its component it is allowed. Empty tables
    give an empty result.
    """
    url = F.col("url")
    rows = stage(pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"),
                              F.when(url.contains("://"), url_key(url)).alias("node"),
                              link_targets(F.col("html")).alias("targets"),
                              F.monotonically_increasing_id().alias("id")), "pages")
    links = rows.where("node is not null").select("url", "node", F.explode("targets").alias("t")) \
        .select("url", "node", resolved(F.col("t"), F.col("url")).alias("to"))
    if redirects is not None:
        links = links.unionByName(redirects.where("src like '%://%'").select(
            F.col("src").alias("url"), url_key(F.col("src")).alias("node"),
            resolved(F.col("dst"), F.col("src")).alias("to")))
    links = stage(links.where("to like '%://%'").withColumn("to_node", url_key(F.col("to"))), "links")
    parts = stage(components(links.select(F.col("node").alias("u"), F.col("to_node").alias("v"))),
                  "components")

    # rules of every address in a component, of pages or not
    named = links.select("node", "url").unionByName(
        links.select(F.col("to_node").alias("node"), F.col("to").alias("url")))
    known = named.groupBy("node").agg(F.min("url").alias("url")).select(
        F.col("node").alias("id"), host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"))
    decided = match_rules(known, rules)
    verdicts = stage(
        parts.join(decided, F.col("node") == F.col("id")).groupBy("component").agg(
            F.max((F.col("verdict") == ALLOW).cast("int")).alias("allowed"),
            F.max((F.col("verdict") == BLOCK).cast("int")).alias("blocked"))
        .select("component", F.when(F.expr("blocked = 1 and allowed = 0"), BLOCK)
                .otherwise(ALLOW).alias("spread")), "verdicts")
    spread = stage(parts.join(verdicts, "component").select("node", "spread"), "spread")

    own = match_rules(rows.select("id", "host", "path"), rules)
    return (rows.drop("targets").join(own, "id", "left").join(spread, "node", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("verdict", "spread", F.lit(ALLOW)).alias("verdict")))
