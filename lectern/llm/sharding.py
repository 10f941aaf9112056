"""Sharding (native): a hierarchical weighted hash tree.

The tree has levels region, rack, shard. From the root down, every child of the node reached
draws ``-ln(u) / weight`` with u from the hash of (key, child's name); the least draw wins, so
a child wins with probability proportional to its weight, the sum of the weights below it.
A change of a weight only moves rows into the subtree that grew (or out of the one that
shrank): draws of other children stay as they are. A new shard comes as a region of its own,
so that rows move only into it and nothing moves between the old shards.

Distribution: the shard is an expression of the key, no shuffle. The slot, a gapless number
within the shard, takes two passes and no global sort: rows are counted by (shard, bin), bin
being a hash of the row; running sums of these bounded counts give each bin's first slot,
and a window numbers the rows of a bin. Bins hold rows / (shards * bins) rows; many rows with
one key spread over bins, because the bin hashes the text's checksum as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SQL_CRC_TABLE, sql_crc32, table

HEX_DIGITS = 13  # 52 bits of the digest: exact in a double


@dataclass(frozen=True)
class Node:
    """A node of the tree; leaves have a shard number and a weight."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int | None = None
    weight: float = 1.0

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight


def tree(shards: int) -> Node:
    """Regions of two racks of two shards each for the first 8; every further shard is a region."""
    def leaf(i: int) -> Node:
        return Node(f"s{i}", shard=i)

    full = min(shards, 8)
    regions = []
    for r in range(0, full, 4):
        racks = tuple(
            Node(f"r{r // 4}k{k}", tuple(leaf(i) for i in range(r + 2 * k, min(r + 2 * k + 2, full))))
            for k in range(2) if r + 2 * k < full
        )
        regions.append(Node(f"r{r // 4}", racks))
    regions += [Node(f"r{i}x", (Node(f"r{i}xk0", (leaf(i),)),)) for i in range(8, shards)]
    return Node("root", tuple(regions))


def _draw(key: Column, node: Node) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{node.name}"))), 1, HEX_DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**HEX_DIGITS)
    return -F.log(u) / F.lit(float(node.total))


def shard_of(key: Column, node: Node) -> Column:
    """The leaf's number that the key (a string) descends to."""
    if not node.children:
        return F.lit(node.shard)
    below = [shard_of(key, c) for c in node.children]
    if len(node.children) == 1:
        return below[0]
    best = F.least(*[_draw(key, c) for c in node.children])
    out = below[-1]
    for c, b in list(zip(node.children, below))[-2::-1]:
        out = F.when(_draw(key, c) == best, b).otherwise(out)
    return out


def shard_rows(
    docs: DataFrame, shards: int = 8, bins: int = 1024, bin_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text",
    keep: tuple[str, ...] = (), order: tuple[str, str] | None = None,
) -> DataFrame:
    """Id, size, text_crc32, law, shard, slot, grown_shard for every row (plus columns ``keep``).

    size: UTF-8 bytes of the text (null: none) plus 1; the checksum of a null text is 0. A null
    id hashes as the empty string. Repeated ids share a shard, each row gets a slot of its own.
    Slots follow (bin, id, checksum, size); rows that tie in all of them are interchangeable. There are ``bins`` bins a shard, or
    more, so that each holds about ``bin_rows`` rows at most. Texts of any length are read whole.
    ``order`` names a column to use as the bin and one to sort it by instead. An empty table
    gives an empty result; other columns are dropped unless named in ``keep``."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    kept = [c for c in keep if c != id_col]
    placed = docs.select(
        F.col(id_col), (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"), shard_of(key, tree(shards)).cast("int").alias("shard"),
        shard_of(key, tree(shards + 1)).cast("int").alias("grown_shard"), *kept,
        *([F.col(order[0]).alias("__bin"), F.col(order[1]).alias("__by")] if order else []),
    )
    if not order:
        bins = max(bins, -(-docs.select(F.lit(1)).count() // (shards * bin_rows)))
        placed = placed.withColumn("__bin", _bin(id_col, bins)).withColumn("__by", F.lit(0))
    counts = placed.groupBy("shard", "__bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    if not order:
        starts = F.broadcast(starts) if shards * bins <= 1_000_000 else starts  # at most shards * bins rows
    within = Window.partitionBy("shard", "__bin").orderBy("__by", id_col, "text_crc32", "size")
    return (
        placed.withColumn("rank", F.row_number().over(within) - 1)
        .join(starts, ["shard", "__bin"])
        .select(id_col, "size", "text_crc32", "law", "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"),
                "grown_shard", *kept)
    )


def _bin(id_col: str, bins: int) -> Column:
    digits = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.col("text_crc32").cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(digits), 1, 8), 16, 10).cast("long"), F.lit(bins)).cast("int")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document (see ``shard_rows``)."""
    return shard_rows(table(spark, sf_dir, "documents"))


def _sql_draw(node: Node) -> str:
    u = f"((CAST('0x' || substr(md5(key || ':{node.name}'), 1, {HEX_DIGITS}) AS BIGINT) + 0.5) / {float(16**HEX_DIGITS)!r})"
    return f"(-ln({u}) / {float(node.total)!r})"


def _sql_shard(node: Node) -> str:
    if not node.children:
        return str(node.shard)
    below = [_sql_shard(c) for c in node.children]
    if len(below) == 1:
        return below[0]
    draws = [_sql_draw(c) for c in node.children]
    best = f"least({', '.join(draws)})"
    cases = " ".join(f"WHEN {d} = {best} THEN {b}" for d, b in list(zip(draws, below))[:-1])
    return f"CASE {cases} ELSE {below[-1]} END"


OP6_SQL = f"""
WITH RECURSIVE {SQL_CRC_TABLE},
summed AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {sql_crc32("text")} AS text_crc32
  FROM documents, crc_table),
placed AS (
  SELECT *, {_sql_shard(tree(8))} AS shard, {_sql_shard(tree(9))} AS grown_shard,
    CAST('0x' || substr(md5(key || ':' || CAST(text_crc32 AS VARCHAR)), 1, 8) AS BIGINT) % 1024 AS bin
  FROM summed)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY bin, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  CAST(grown_shard AS INTEGER) AS grown_shard
FROM placed
"""
