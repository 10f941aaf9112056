"""Structured Streaming front end: files of page XML that land in a folder are corrected batch by batch.

Each file is a document of its own, so a micro-batch is complete in itself; a batch writes into a folder
of its number, so a repeated batch overwrites what it had written (exactly once per file)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import rules
from ..plans import correction
from ..plans.store import written
from ..sources import ocr_xml

BINARY = "path string, modificationTime timestamp, length long, content binary"


def correct_batch(files: DataFrame, rule_list: list[rules.Rule] | None = None) -> DataFrame:
    """New files for files (path, content), each a document of its own. A file that cannot be read is a row with
    its ``error``, its content as it was and ``delivered`` false; it holds up no other."""
    parsed = written(ocr_xml.lines_of(files).withColumn("doc_id", F.col("source_file")))
    return correction.rewritten(files.select("path", "content"), parsed.where("error is null").drop("error"), rule_list=rule_list).files


def correct_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, rule_list: list[rules.Rule] | None = None, glob: str = "*.xml") -> StreamingQuery:
    """Start correcting the files that land in ``folder``; stops when all that is there is done."""
    arriving = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).load(folder)

    def one(batch: DataFrame, number: int) -> None:
        correct_batch(batch, rule_list).select("source_file", "content", "delivered", "error").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
