"""Mixing sources to target weights (native): Pfair scheduling of blocks.

Each source's rows form blocks. Its j-th block may not run before its release
``floor(j / w)`` and must run before its deadline ``ceil((j + 1) / w)``, w being the source's
weight over the sum of all weights, exactly; in every slot the released block with the earliest
deadline runs. On one resource this meets every deadline, so after any number of slots each source
is less than one block away from its target, until its rows end. When a source has no rows left
its slots stay empty; all other rows keep their order and none is dropped or repeated.

Distribution: the driver gets one row a source (weight and number of rows) and runs through the blocks
once with two heaps, in exact integers; slots, releases and deadlines go back as arrays of ``PART``
blocks, broadcast up to ``BROADCAST_BLOCKS`` blocks and joined by a shuffle beyond. Rows are numbered
within their source by bins, as in ``sharding``: counts by (source, bin), running sums of these, and a
window over each bin. A source with a third of all rows is spread over all of its bins.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SQL_CRC_TABLE, md5_long, sql_crc32, table

#: Blocks in one row of the schedule, and the longest schedule that is broadcast (24 bytes a block).
PART, BROADCAST_BLOCKS = 4096, 1_000_000


def temperature_weights(docs: DataFrame, exponent: float = 0.5, source_col: str = "source") -> DataFrame:
    """Target weights (source, weight): row counts to a power, which lifts small sources."""
    return (
        docs.groupBy(F.coalesce(source_col, F.lit("")).alias("source"))
        .agg((F.sqrt(F.count("*").cast("double")) if exponent == 0.5 else F.pow(F.count("*").cast("double"), F.lit(exponent))).alias("weight"))
    )


def schedule(weights: dict[str, float], blocks: dict[str, int]) -> dict[str, tuple[array, array, array]]:
    """Slots, releases and deadlines of the blocks of every source; weights are taken as exact fractions."""
    exact = {s: Fraction(weights[s]) for s in sorted(weights)}
    scale = math.lcm(*(w.denominator for w in exact.values())) if exact else 1
    share = {s: int(w * scale) for s, w in exact.items()}
    total = sum(share.values())
    names = [s for s in share if blocks.get(s, 0) > 0]
    parts, ends = [share[s] for s in names], [blocks[s] for s in names]
    out = [(array("q"), array("q"), array("q")) for _ in names]
    waiting, ready, t = [(0, i) for i in range(len(names))], [], 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            release, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(out[i][0]) + 1) * total // parts[i]), i, release))
        deadline, i, release = heapq.heappop(ready)
        for column, x in zip(out[i], (t, release, deadline)):
            column.append(x)
        if (done := len(out[i][0])) < ends[i]:
            heapq.heappush(waiting, (done * total // parts[i], i))
        t += 1
    return dict(zip(names, out, strict=True))


def _frame(spark: SparkSession, plan: dict[str, tuple[array, array, array]]) -> DataFrame:
    """The schedule as rows of up to ``PART`` blocks of a source, without an object a block."""
    at = [(s, k) for s, runs in plan.items() for k in range(0, len(runs[0]), PART)]
    lists = [pa.array([np.frombuffer(plan[s][c], dtype="int64")[k : k + PART] for s, k in at], pa.list_(pa.int64())) for c in range(3)]
    columns = [pa.array([s for s, _ in at], pa.string()), pa.array([k // PART for _, k in at], pa.int64()), *lists]
    return spark.createDataFrame(pa.table(columns, names=["__source", "__part", "__slot", "__release", "__deadline"]))


def mix(
    docs: DataFrame, weights: DataFrame | None = None, block_rows: int = 16, bins: int = 256, bin_rows: int = 200_000,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (),
    total: str | None = None,
) -> DataFrame:
    """Id, source, block, slot, seq, release, deadline for every row (plus columns ``keep`` and, under the name ``total``, the
    number of slots of the schedule).

    Sorting by (slot, seq) gives the mixture. A null source is the source with the empty name.
    Rows of sources without a weight are an error. The driver holds one row a source and 24 bytes a block, so ``block_rows``
    should grow with the table (4096 at 10^10 rows). Weights of a repeated source add up; those that are null or not positive count as the
    smallest of the others. After any number of slots a source that still has rows is less than one block away from its exact target.
    Rows are numbered by (bin, id, checksum of the text); rows that tie in all of these are interchangeable. There are ``bins`` bins a source
    or more, so that the largest source has about ``bin_rows`` rows in each; ids that repeat or are null spread by their texts. An empty table
    gives an empty result. Other columns are dropped."""
    spark = docs.sparkSession
    weights = temperature_weights(docs, source_col=source_col) if weights is None else weights.select(
        F.coalesce("source", F.lit("")).alias("source"), F.col("weight").cast("double").alias("weight")).groupBy("source").agg(F.sum("weight").alias("weight"))
    given = {r["source"]: r["weight"] or 0.0 for r in weights.collect()}  # one row a source
    if not all(math.isfinite(w) for w in given.values()):
        raise ValueError("weights must be finite")
    least = min((w for w in given.values() if w > 0), default=1.0)
    given = {s: w if w > 0 else least for s, w in given.items()}
    named = docs.withColumn("__source", F.coalesce(F.col(source_col), F.lit("")))
    sizes = {r[0]: r[1] for r in named.groupBy("__source").count().collect()}
    if missing := sorted(sizes.keys() - given.keys()):
        raise ValueError(f"no weight for source {missing[0]}")
    bins = max(bins, -(-max(sizes.values(), default=0) // bin_rows))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")) if text_col in docs.columns else F.lit("")
    rest = [c for c in keep if c not in (id_col, source_col)]
    rows = named.select(F.col(id_col), "__source", *rest, F.crc32(text.cast("binary")).alias("__sum")).withColumn(
        "__bin", (md5_long(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("__sum").cast("string"))) % bins).cast("int"))
    plan = schedule(given, {s: -(-n // block_rows) for s, n in sizes.items()})
    slots = _frame(spark, plan)
    slots = F.broadcast(slots) if sum(len(runs[0]) for runs in plan.values()) <= BROADCAST_BLOCKS else slots
    counts = rows.groupBy("__source", "__bin").agg(F.count("*").alias("n"))  # at most sources * bins rows
    before = Window.partitionBy("__source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__source", "__bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    starts = F.broadcast(starts) if len(given) * bins <= 1_000_000 else starts
    within = Window.partitionBy("__source", "__bin").orderBy(id_col, "__sum")
    at = F.col("__start") + F.row_number().over(within) - 1
    numbered = rows.join(starts, ["__source", "__bin"]).withColumn("__at", at).withColumn("block", F.expr(f"__at div {block_rows}"))
    placed = numbered.withColumn("__part", F.expr(f"block div {PART}")).join(slots, ["__source", "__part"], "left")
    of_block = lambda c: F.coalesce(F.get(c, F.expr(f"int(block % {PART})")), F.raise_error(F.lit("rows changed while they were mixed")).cast("long"))
    return placed.select(
        id_col, F.col("__source").alias(source_col), "block", of_block("__slot").alias("slot"),
        (F.col("__at") % block_rows).cast("int").alias("seq"),
        of_block("__release").alias("release"), of_block("__deadline").alias("deadline"), *rest,
        *([F.lit(1 + max((runs[0][-1] for runs in plan.values()), default=0)).alias(total)] if total else []))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, block, slot, seq, release, deadline for every document (see ``mix``), weights being square roots of the counts."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


#: Weights are square roots of counts, at least 1, so times 2^52 they are whole numbers. The recursion deals out one slot a step.
OP9_SQL = f"""
WITH RECURSIVE shares AS (
  SELECT coalesce(source, '') AS source, CAST(sqrt(count(*)) * 4503599627370496.0 AS HUGEINT) AS c,
    (count(*) + 15) // 16 AS blocks, row_number() OVER (ORDER BY coalesce(source, '')) AS i
  FROM documents GROUP BY 1),
packed AS (SELECT list(c ORDER BY i) AS c, list(blocks ORDER BY i) AS ends, sum(c)::HUGEINT AS h, CAST(count(*) AS BIGINT) AS n FROM shares),
sim(t, nxt, ran) AS (
  SELECT CAST(-1 AS HUGEINT), list_transform(c, lambda x: CAST(0 AS HUGEINT)),
    CAST(NULL AS STRUCT(d HUGEINT, i BIGINT, j HUGEINT)) FROM packed
  UNION ALL
  SELECT due, list_transform(range(1, n + 1), lambda k: CASE WHEN k = pick.i THEN nxt[k] + 1 ELSE nxt[k] END), pick
  FROM (
    SELECT *, list_min(list_filter(list_transform(range(1, n + 1), lambda k:
        CASE WHEN nxt[k] < ends[k] AND nxt[k] * h // c[k] <= due
          THEN struct_pack(d := ((nxt[k] + 1) * h + c[k] - 1) // c[k], i := k, j := nxt[k]) END), lambda x: x IS NOT NULL)) AS pick
    FROM (
      SELECT *, greatest(t + 1, list_min(list_filter(list_transform(range(1, n + 1), lambda k:
        CASE WHEN nxt[k] < ends[k] THEN nxt[k] * h // c[k] END), lambda x: x IS NOT NULL))) AS due
      FROM sim, packed
      WHERE list_sum(list_transform(range(1, n + 1), lambda k: ends[k] - nxt[k])) > 0))),
plan AS (
  SELECT source, ran.j AS j, t AS slot, ran.j * (SELECT h FROM packed) // c AS release, ran.d AS deadline
  FROM sim JOIN shares ON shares.i = sim.ran.i),
summed AS (SELECT doc_id, source, {sql_crc32("text")} AS text_crc32 FROM documents, crc_table),
numbered AS (
  SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (
      PARTITION BY coalesce(source, '')
      ORDER BY CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(text_crc32 AS VARCHAR)), 1, 8) AS BIGINT) % 256,
        doc_id NULLS FIRST, text_crc32) - 1 AS pos
  FROM summed)
SELECT doc_id, source, pos // 16 AS block, CAST(slot AS BIGINT) AS slot, CAST(pos % 16 AS INTEGER) AS seq,
  CAST(release AS BIGINT) AS release, CAST(deadline AS BIGINT) AS deadline
FROM numbered JOIN plan USING (source) WHERE pos // 16 = j
""".replace("WITH RECURSIVE ", f"WITH RECURSIVE {SQL_CRC_TABLE}, ", 1)
