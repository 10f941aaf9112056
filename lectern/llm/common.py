"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_frame(spark: SparkSession, rows, **columns: str) -> DataFrame:
    """A small frame of literals (name=type), made in the plan itself."""
    fields = list(columns.items())
    structs = [F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(row, fields, strict=True)]) for row in rows]
    kind = f"array<struct<{', '.join(f'{c}: {t}' for c, t in fields)}>>"
    return spark.range(1).select(F.inline(F.array(*structs).cast(kind)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Sessions on one machine (master ``local``) may leave it out; anywhere else that is an error, because
    other machines would not see a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found or "file:///tmp/checkpoints/lectern"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written to the shared folder.

    The files outlive any executor, so a lost one costs only its running tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bucket(n: int, *cols: str | Column) -> Column:
    """A bucket number 0..n-1 from the columns' hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def md5_long(text: Column, digits: int = 8) -> Column:
    """The first hex digits of the text's md5 as a number; DuckDB can compute the same."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def node_key(id_col: str, digest: str) -> Column:
    """A key for (id, digest) that sorts like the id: 8 bytes of the id, then the digest."""
    flipped = F.col(id_col).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    return F.concat(F.unhex(F.lpad(F.hex(flipped), 16, "0")), F.col(digest))


def node_id(node: str | Column) -> Column:
    """The id in a ``node_key``."""
    signed = F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long")
    return signed.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


#: DuckDB has no CRC-32: its table as a recursion, and the checksum of a text (null: empty) by a fold over the bytes.
SQL_CRC_TABLE = """bytes(n, v) AS (
  SELECT i, CAST(i AS BIGINT) FROM range(256) t(i)),
steps(k, n, v) AS (
  SELECT 0, n, v FROM bytes
  UNION ALL SELECT k + 1, n, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY n) AS crc FROM steps WHERE k = 8)"""


def sql_crc32(text: str) -> str:
    codes = f"list_transform(regexp_extract_all(hex(encode(coalesce({text}, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: xor(c >> 8, crc[xor(c, b) % 256 + 1])), 4294967295)"
