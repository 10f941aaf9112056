"""From raw documents to shards of a training mixture.

Five stages, each over all rows that the one before kept, written as Parquet in between:
language identification (documents without a letter or a clear language go), near-duplicates
(one document of each class stays), benchmark decontamination (contaminated documents go),
mixing (the rows are written in the mixture's order) and sharding (rows get a shard and a slot;
slots follow the mixture's order)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import cut, shuffle_parts, table
from lectern.llm.decontaminate import benchmark_hits, is_contaminated
from lectern.llm.language_id import identify, train
from lectern.llm.mixing import mix
from lectern.llm.ngram_join import jaccard_classes
from lectern.llm.sharding import shard_rows

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language is less certain than this are rejected.
LEAST_SCORE = 0.5
#: Id lists up to this length are broadcast; longer ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a predicted language; a null language is filled with the prediction."""
    model = train(docs.select("doc_id", "text", "lang"))
    found = identify(docs.select(*COLUMNS), model, pred="__lang", score="__score")
    kept = found.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates. A row goes only if its own text is a copy: decisions are keyed by id and text, so
    a document that shares its id with another's copy stays. Of rows that repeat both, one stays. Rows with a null id stay."""
    rows = docs.select(*COLUMNS).withColumn("__row", F.xxhash64("text"))
    classes = cut(jaccard_classes(docs.select("doc_id", "text"), row="__row"))
    key = ["doc_id", "__row"]
    repeated = classes.where("kept and doc_id is not null").groupBy(*key).count().where("count > 1").select(*key, F.lit(True).alias("__again"))
    touched = cut(classes.where("not kept").select(*key, F.lit(False).alias("__again")).distinct().unionByName(repeated))
    few = touched.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    joined = rows.join(F.broadcast(touched) if few else touched, key, "left").where("__again is null or __again")
    alone, again = joined.where("__again is null"), joined.where("__again")
    if touched.where("__again").limit(1).count():
        alone = alone.unionByName(again.dropDuplicates(key))
    return alone.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = benchmark_hits(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), hits="__hits")
    return found.where(~is_contaminated("__hits")).select(*COLUMNS)


def in_mixture_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, ordered by the mixture's schedule over the partitions and within them.

    The schedule itself knows how many slots it has, so the mixture is computed once."""
    parts = shuffle_parts(spark)
    mixed = mix(docs, keep=COLUMNS, total="__slots")
    place = F.expr(f"cast(slot * {parts} div __slots as int)")
    return mixed.repartitionById(parts, place).sortWithinPartitions("slot", "seq").select(*COLUMNS)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, shard, slot and the sizes, with the document; slots follow the rows' order in the files read."""
    order = None
    try:
        docs = docs.select(*COLUMNS, F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        order = ("__file", "__row")
    except AnalysisException:  # not read from files: the operator's own order
        pass
    return shard_rows(docs, keep=COLUMNS, order=order)


STAGES = [
    ("language_id", keep_language),
    ("near_duplicates", keep_one_of_each),
    ("decontaminate", drop_contaminated),
    ("mixing", in_mixture_order),
    ("sharding", into_shards),
]

#: The language model is trained, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))  # the stage's own frame, and the broadcasts it holds, are let go here
    return STAGES[-1][1](spark, docs, sf_dir)
