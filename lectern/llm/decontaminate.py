"""Benchmark decontamination by greedy string tiling.

Words are compared, lower-cased. A document and a benchmark item that share a run of
``MIN_MATCH`` words are tiled: again and again the longest
match of words not yet marked on either side is marked, ties by the place in the item and then in the
document, until no match of that length is left. The coverage is the share of the item's words
in tiles; passages in another order are covered all the same. From ``COVERAGE`` on the document
is contaminated.

Seeds are Karp-Rabin hashes of all runs of the document, looked up among the benchmark's and
compared word by word; matches along a diagonal are runs of seeds, so longer matches need no further search.
Repetitive texts, in which an item's seeds meet more than ``PAIRS`` times, are tiled with hashes of
all lengths instead (``tile_long``), in memory that follows the lengths and with equal results.

Distribution: up to ``PART_CHARS`` characters, measured first, the benchmark is broadcast and the search is a narrow map
over the documents. A larger benchmark is joined: its seeds by a shuffle to the documents' seeds (those that
pass a bit table of fixed size), then the two texts of each pair that shares one; nothing of it reaches the driver.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, table
from .words import STEP, mixed, windows, word_hashes, words

MIN_MATCH = 5
COVERAGE = 0.5
#: A benchmark up to this many characters is broadcast.
PART_CHARS = 16_000_000
#: Seed pairs of a document that are held at once.
PAIRS = 2_000_000
#: Words of the bit table (64 bits each) that thins out the documents' seeds before they are joined.
BITS = 1 << 19
HITS = "array<struct<item_id:bigint,coverage:double,tiles:array<struct<item_at:int,doc_at:int,words:int>>>>"
_TILE = pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("words", pa.int32())])
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(_TILE))]))


def tile(n_item: int, n_doc: int, i: np.ndarray, j: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item_at, doc_at, words) from all seed matches (i, j) of ``seed`` words."""
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    new = np.flatnonzero(np.append(True, (np.diff(j - i) != 0) | (np.diff(i) != 1)))
    length = np.diff(np.append(new, len(i))) + seed - 1
    heap = [(-n, a, b) for n, a, b in zip(length.tolist(), i[new].tolist(), j[new].tolist())]
    heapq.heapify(heap)
    item, doc, tiles = np.zeros(n_item, bool), np.zeros(n_doc, bool), []
    while heap:
        n, a, b = heapq.heappop(heap)
        taken = item[a : a - n] | doc[b : b - n]
        if not taken.any():
            tiles.append((a, b, -n))
            item[a : a - n] = doc[b : b - n] = True
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([1], taken.view(np.int8), [1]))))
        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if y - x >= seed:
                heapq.heappush(heap, (x - y, a + x, b + x))
    return tiles


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, STEP, np.uint64), out=out[1:])
    return out


class _Prefixes:
    """Hashes of all runs of any length, from those of the beginnings."""

    def __init__(self, ids: np.ndarray, power: np.ndarray):
        self.n, self.power = len(ids), power
        back = _inverse_powers(len(ids))
        self.sums = np.append(np.uint64(0), np.cumsum(mixed(ids) * back[: len(ids)], dtype=np.uint64))

    def runs(self, n: int, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the runs of n words that are all free; ``free`` counts the taken words before each place."""
        at = np.flatnonzero(free[n:] == free[: len(free) - n])
        return at, (self.sums[at + n] - self.sums[at]) * self.power[at]


def _inverse_powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, np.uint64(pow(int(STEP), -1, 1 << 64))), out=out[1:])
    return out


def tile_long(item: np.ndarray, doc: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """The greedy tiles without a list of seed matches: the longest length that still matches is found by halving,
    with hashes of all runs of that length on both sides; its matches are marked in order, then the next shorter is sought."""
    power = _powers(max(len(item), len(doc)))
    left, right = _Prefixes(item, power), _Prefixes(doc, power)
    took = [np.zeros(len(item), bool), np.zeros(len(doc), bool)]
    before = lambda x: np.append(0, np.cumsum(x))
    tiles: list[tuple[int, int, int]] = []

    def first(n: int) -> tuple[int, int] | None:
        a, x = left.runs(n, before(took[0]))
        b, y = right.runs(n, before(took[1]))
        order = np.argsort(y, kind="stable")
        at = np.searchsorted(y[order], x)
        for k in np.flatnonzero(at < len(y)):
            j = at[k]
            while j < len(y) and y[order[j]] == x[k]:
                if (item[a[k] : a[k] + n] == doc[b[order[j]] : b[order[j]] + n]).all():
                    return int(a[k]), int(b[order[j]])
                j += 1
        return None

    most = min(len(item), len(doc))
    while most >= seed and first(seed):
        low, high = seed, most
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if first(n) else (low, n - 1)
        while hit := first(low):
            tiles.append((*hit, low))
            took[0][hit[0] : hit[0] + low] = took[1][hit[1] : hit[1] + low] = True
        most = low - 1
    return tiles


@dataclass
class Benchmark:
    """Items as word numbers and, by seed length, the sorted seed hashes with their places."""

    vocab: dict[str, int]
    ids: list[int]
    items: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def __post_init__(self) -> None:
        self.first = np.append(0, np.cumsum([len(x) for x in self.items])).astype(np.int64)
        self.joined = np.concatenate(self.items) if self.items else np.zeros(0, np.uint64)

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], min_match: int = MIN_MATCH) -> Benchmark:
        vocab: dict[str, int] = {}
        ids, items = [], []
        for item_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or "")):
            found = [vocab.setdefault(w, len(vocab) + 1) for w in words(text)]
            if len(found) >= min_match:
                ids.append(item_id)
                items.append(np.array(found, np.uint64))
        seeds = {}
        if items:
            hashes = [windows(x, min_match) for x in items]
            h = np.concatenate(hashes)
            item = np.repeat(np.arange(len(items)), [len(x) for x in hashes])
            at = np.concatenate([np.arange(len(x)) for x in hashes])
            order = np.argsort(h, kind="stable")
            seeds[min_match] = (h[order], item[order], at[order])
        return cls(vocab, ids, items, seeds)

    def hits(self, text: str | None, pairs: int | None = None) -> list[dict]:
        """Every item with a tile in the text, by item."""
        pairs = PAIRS if pairs is None else pairs
        found = list(map(self.vocab.get, tokens := words(text)))
        if len(found) - found.count(None) == 0:
            return []
        doc = np.array([x or 0 for x in found], np.uint64)
        tiles: dict[int, list] = {}
        for n, (hashes, item, at) in self.seeds.items():
            w = windows(doc, n)
            lo = np.searchsorted(hashes, w, "left")
            count = np.searchsorted(hashes, w, "right") - lo
            if not count.any():
                continue
            if count.sum() > pairs:
                _, once = np.unique(w[count > 0], return_index=True)
                lo, count = lo[count > 0][once], count[count > 0][once]
                k = np.repeat(lo - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
                for it in np.unique(item[k]).tolist():
                    tiles[it] = tile_long(self.items[it], doc, n)
                continue
            j = np.repeat(np.arange(len(w)), count)
            k = np.repeat(lo - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
            same = np.ones(len(j), bool)
            for d in range(n):
                same &= doc[j + d] == self.joined[self.first[item[k]] + at[k] + d]
            j, k = j[same], k[same]
            for it in np.unique(item[k]).tolist():
                own = item[k] == it
                tiles[it] = tile(len(self.items[it]), len(tokens), at[k][own], j[own], n)
        out = [{"item_id": self.ids[it], "coverage": sum(t[2] for t in made) / len(self.items[it]),
                "tiles": [dict(zip(("item_at", "doc_at", "words"), t)) for t in made]} for it, made in tiles.items() if made]
        return sorted(out, key=lambda x: (x["item_id"] is None, x["item_id"]))


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", hits: str = "hits", item_id: str = "item_id",
    item_text: str = "text", min_match: int = MIN_MATCH, part_chars: int = PART_CHARS,
) -> DataFrame:
    """``docs`` with the array ``hits`` of (item_id, coverage, tiles), one entry an item.

    Null and empty texts have no hits. Items of fewer than ``min_match`` words cannot be told from chance and hit nothing;
    repeated items are separate hits; an empty benchmark or table is no error. Texts of any length, also of one word
    repeated a million times, are searched whole. Document ids are not used, so they may be null or repeated. A
    column named ``hits`` is replaced."""
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    rest = docs.drop(hits)
    if chars > part_chars:
        return _joined_hits(rest, items, text_col, hits, min_match)
    b = Benchmark.of([tuple(r) for r in items.collect()], min_match)  # at most part_chars characters
    if not b.items:
        return rest.withColumn(hits, F.expr(f"cast(array() as {HITS})"))
    shared = docs.sparkSession.sparkContext.broadcast((b.vocab, b.ids, b.items, b.seeds))
    schema = StructType([*rest.withColumn(hits, F.expr(f"cast(array() as {HITS})")).schema.fields])

    def run(batches):
        bench = Benchmark(*shared.value)
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                found = [bench.hits(x) for x in batch.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _HITS)], [*batch.schema.names, hits])

    return rest.mapInArrow(run, schema)


def _seeds_of(n: int, bits=None):
    """key and every distinct seed of the texts; with a bit table, only seeds that are in it."""

    def run(batches):
        table_ = bits.value if bits is not None else None
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                keys, seeds = [], []
                for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                    found = np.unique(mixed(windows(word_hashes(words(text)), n)))
                    if table_ is not None:
                        found = found[(table_[(found >> np.uint64(6)) % np.uint64(len(table_))] >> (found & np.uint64(63))) & np.uint64(1) > 0]
                    keys += [key] * len(found)
                    seeds.append(found)
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.concatenate(seeds).view(np.int64))], ["key", "seed"])

    return run


def _joined_hits(docs: DataFrame, items: DataFrame, text_col: str, hits: str, n: int) -> DataFrame:
    """The same for a benchmark of any size; equal texts, on either side, are worked on once."""
    spark = docs.sparkSession
    md5 = lambda c: F.unhex(F.md5(F.col(c).cast("binary")))
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null").select(md5("text").alias("key"), "text")
    tests = items.select(md5("text").alias("key"), "id", "text")
    seeds = cut(tests.select("key", "text").dropDuplicates(["key"]).mapInArrow(_seeds_of(n), "key binary, seed long"))
    word = F.pmod(F.shiftrightunsigned("seed", 6), F.lit(BITS))
    set_ = seeds.select(word.alias("word"), F.expr("shiftleft(1L, cast(seed & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(BITS, np.uint64)  # BITS words at most reach the driver
    bits[set_.column("word").to_numpy()] = set_.column("bits").to_numpy().view(np.uint64)
    asked = texts.mapInArrow(_seeds_of(n, spark.sparkContext.broadcast(bits)), "key binary, seed long")
    both = cut(asked.join(seeds.withColumnRenamed("key", "item"), "seed").select("key", "item").distinct())
    pairs = both.join(tests.select(F.col("key").alias("item"), "id", F.col("text").alias("test")), "item")
    pairs = pairs.join(texts.dropDuplicates(["key"]), "key").select("key", "id", "test", "text")

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                batch = whole.slice(a, 64)
                found = [Benchmark.of([(i, test)], n).hits(text) for i, test, text in zip(*(batch.column(c).to_pylist() for c in ("id", "test", "text")))]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, _HITS)], ["key", hits])

    made = pairs.mapInArrow(run, f"key binary, {hits} {HITS}").groupBy("key").agg(F.flatten(F.collect_list(hits)).alias(hits))
    made = made.withColumn(hits, F.array_sort(hits, lambda x, y: F.when(x["item_id"].eqNullSafe(y["item_id"]), 0).when(x["item_id"].isNull(), 1).when(
        y["item_id"].isNull(), -1).when(x["item_id"] < y["item_id"], -1).otherwise(1)))
    keyed = docs.withColumn("__key", F.unhex(F.md5(F.col(text_col).cast("binary"))))
    return keyed.join(made.withColumnRenamed("key", "__key"), "__key", "left").select(
        *docs.columns, F.coalesce(hits, F.expr(f"cast(array() as {HITS})")).alias(hits))


def is_contaminated(hits: str = "hits", coverage: float = COVERAGE):
    return F.exists(hits, lambda h: h["coverage"] >= coverage)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, coverage of the item covered most (0 if none), that item, its number of tiles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = benchmark_hits(docs, table(spark, sf_dir, "benchmark")).drop("text")
    best = F.try_element_at(F.array_sort(F.transform("hits", lambda h: F.struct(
        (-h["coverage"]).alias("c"), h["item_id"].alias("item_id"), F.size(h["tiles"]).alias("n")))), F.lit(1))
    return found.withColumn("best", best).select(
        "doc_id", is_contaminated().alias("contaminated"), F.coalesce(-F.col("best.c"), F.lit(0.0)).alias("coverage"),
        F.col("best.item_id").alias("item_id"), F.coalesce("best.n", F.lit(0)).alias("n_tiles"),
    )
