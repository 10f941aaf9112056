"""URL filtering by nested host and path rules (native).

A rule (host, path, verdict) fits a URL whose host is the rule's host or one of its
subdomains and whose path starts with the rule's path. Of the rules that fit, the one
with the longest ``host + path`` wins (ties: the longer host).

Method: sort-merge range join. The canonical key of a rule is its host's labels in
reverse order, a slash that ends the host (no host holds one), and its path (``example.com`` + ``/en/`` ->
``com.example//en/``), so a rule is the interval of all keys that start with its key, and the intervals either
nest or are disjoint; a host never is the beginning of another. A URL asks once for each ancestor domain, no deeper than the deepest
rule: ``com//en/x``, ``com.example//en/x``, ... Rules and questions are sorted together by
key. The sweep carries the stack of the rules that were open when the last rule began; a
question pops those whose interval ended before it and takes what is then on top.

Distribution: questions are dealt out by a hash of the row, not by host, so a host with a
third of all URLs is spread evenly; every bucket gets a copy of the rules. The window is a
running ``last`` over a sorted partition and holds one row at a time. The rules times
buckets are bounded by ``max_rule_copies``; in larger rule sets rules and questions meet by the host of the key:
a host's questions are spread over as many buckets as ``QUESTIONS`` of each need, and only that host's rules are copied
to these. Questions about hosts without a rule are not sent at all.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket, rows_frame, shuffle_parts, table

#: Questions about one host that go into one bucket, where rules are dealt by host.
QUESTIONS = 500_000
#: The rules of the registered query: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, "\\.", -1)), ".")


def rules_frame(spark: SparkSession, rules) -> DataFrame:
    return rows_frame(spark, rules, host="string", path="string", verdict="string")


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """Each rule's key with the stack of rules open there, outermost first.

    Found by equi-joining every rule's prefixes, at lengths that occur, to the rule keys.
    Repeated (host, path) rules count once: ``block`` before ``allow``."""
    keyed = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            F.concat(reversed_host(F.col("host")), F.lit("/"), F.col("path")).alias("key"),
            reversed_host(F.col("host")).alias("site"),
            F.concat("host", "path").alias("rule"),
            "verdict",
            F.length("host").alias("host_len"),
            F.size(F.split("host", "\\.", -1)).alias("depth"),
        )
    )
    lengths = keyed.agg(F.sort_array(F.collect_set(F.length("key"))).alias("lengths"))
    outer = keyed.select(
        F.col("key").alias("outer_key"),
        F.struct(F.col("key").alias("key"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict"),
                 F.col("host_len").alias("host_len")).alias("entry"),
    )
    return (
        keyed.crossJoin(F.broadcast(lengths))  # one row of lengths
        .select("key", "site", "depth", F.explode(F.filter("lengths", lambda n: n <= F.length("key"))).alias("n"))
        .select("key", "site", "depth", F.expr("substring(key, 1, n)").alias("outer_key"))
        .join(outer, "outer_key")
        .groupBy("key", "site", "depth")
        .agg(F.array_sort(F.collect_list("entry")).alias("stack"))
    )


def url_verdicts(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_rule_copies: int = 5_000_000,
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (null if none fits), verdict.

    Null URLs and URLs without ``://`` have an empty host and path; no rule with a host fits
    them, so they get ``default``. Repeated rows stay repeated, null ids stay null; an empty
    table gives an empty result. A rule with an empty path fits all paths of its host and the subdomains, not hosts that merely
    begin alike. URLs of any length are read whole. Other columns of ``pages`` are not read, so none can clash.
    Rules with a null in any column are ignored."""
    spark = pages.sparkSession
    stacks = _rule_stacks(rules)
    n_rules, deepest = stacks.agg(F.count("*"), F.coalesce(F.max("depth"), F.lit(1))).first()
    buckets = 4 * shuffle_parts(spark)
    by_site = n_rules * buckets > max_rule_copies
    asked = pages.select(
        F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")
    )
    probes = asked.withColumn("labels", F.reverse(F.split("host", "\\.", -1))).select(
        "id", "host", "path",
        F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(deepest)))).alias("level"), "labels",
    ).select(
        "id", "host", "path", "level", F.array_join(F.slice("labels", 1, F.col("level")), ".").alias("site"),
    ).withColumn("key", F.concat("site", F.lit("/"), "path"))
    if by_site:
        sites = stacks.select("site").distinct()
        spread = probes.groupBy("site").agg(F.ceil(F.count("*") / QUESTIONS).cast("int").alias("n")).join(sites, "site")
        opened = stacks.join(spread, "site").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        # the first question of every URL stays even where no rule can answer it
        probes = probes.join(spread, "site", "left").where("n is not null or level = 1")
        probes = probes.withColumn("salt", F.pmod(F.xxhash64("id", "host", "path"), F.coalesce("n", F.lit(buckets))).cast("int"))
        probes = probes.withColumn("part", F.when(F.col("n").isNotNull(), F.col("site")).otherwise(""))
        opened = opened.withColumn("part", F.col("site"))
    else:
        probes = probes.withColumn("salt", bucket(buckets, "id", "host", "path")).withColumn("part", F.lit(""))
        opened = stacks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).withColumn("part", F.lit(""))
    probes = probes.select(
        "id", "host", "path", "salt", "part", "level", "key",
        F.lit(None).cast("array<struct<key:string,rule:string,verdict:string,host_len:int>>").alias("stack"))
    opened = opened.select(
        F.lit(None).cast(pages.schema[id_col].dataType).alias("id"), F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("string").alias("path"), "salt", "part", F.lit(0).alias("level"), "key", "stack",
    )
    sweep = Window.partitionBy("salt", "part").orderBy("key", "level").rowsBetween(Window.unboundedPreceding, 0)
    answered = (
        probes.unionByName(opened)
        .withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
        .where("level > 0")
        .withColumn("top", F.expr("try_element_at(filter(open, r -> startswith(key, r.key)), -1)"))
    )
    return (
        answered.groupBy("id", "host", "path")
        .agg(
            F.max(F.when(F.col("top").isNotNull(), F.struct(
                F.length("top.rule").alias("n"), F.col("top.host_len").alias("h"),
                F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict")))).alias("won"),
            F.sum((F.col("level") == 1).cast("int")).alias("copies"),
        )
        .select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .select(
            F.col("id").alias(id_col), "host", "path", F.col("won.rule").alias("rule"),
            F.coalesce("won.verdict", F.lit(default)).alias("verdict"),
        )
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict for every page (see ``url_verdicts``); without a rule the verdict is allow."""
    return url_verdicts(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
OP8_SQL = f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {_RULE_ROWS}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT row_number() OVER () AS row_id, page_id,
    translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
best AS (
  SELECT row_id, arg_max(struct_pack(rule := rhost || rpath, verdict := rverdict), length(rhost || rpath) * 10000 + length(rhost)) AS won
  FROM parts JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)
  GROUP BY row_id)
SELECT page_id, host, path, won.rule AS rule, coalesce(won.verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (row_id)
"""
