"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``max_order``. A byte that was seen in its
context costs ``-log2(n / (total + distinct))`` bits; otherwise the escape costs
``-log2(distinct / (total + distinct))`` and the next shorter context is asked, down to 8 bits
for a byte that was never seen. The statistics are frozen, so the cost of a byte depends only
on the bytes before it and whole texts can be scored by table look-ups: all languages share
one tree, whose nodes hold for each language that has seen them the cost of each byte and of the escape. The language with
the least code length wins; the score is its posterior among the languages.

Texts are lower-cased; ASCII bytes that are no letters count as one blank a run.

Distribution: the trees are learnt from a sample of labelled rows, bounded in rows a language and in bytes
(``train``); n-grams are counted on the executors and only their counts, bounded by the sample, reach the
driver. Scoring is a narrow map without a shuffle, whole texts in slices of bounded memory.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, table

SLICE = 1 << 19  # symbols of a group of texts scored at a time
GROUP = 32  # languages with dense columns at a time
DENSE = 1 << 24  # cells of the largest dense table
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


def folded(text: str) -> np.ndarray:
    """The bytes that the model sees."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace").translate(_FOLD), np.uint8)
    blank = raw == 32
    return raw[~(blank & np.concatenate(([True], blank[:-1])))] if len(raw) else raw


class Lookup:
    """(row, column) -> value, 0 where there is none: a dense table if it is small, else a sorted list."""

    def __init__(self, rows: int, width: int, keys: np.ndarray, values: np.ndarray):
        self.width, self.dense = width, None
        if rows * width <= DENSE:
            self.dense = np.zeros(rows * width, np.int32)
            self.dense[keys] = values
        else:
            order = np.argsort(keys)
            self.keys, self.values = np.append(keys[order], np.iinfo(np.int64).max), np.append(values[order], 0)

    def __call__(self, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        key = row.astype(np.int64) * self.width + column
        if self.dense is not None:
            return self.dense[key]
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], 0)


@dataclass
class PpmModel:
    """Frozen statistics of all languages, sparse: a context or a byte holds only the languages that have seen it.

    Node 0 is none, node 1 the empty context; an entry is a byte seen in a context by some language, entry 0 is none.
    Memory follows the number of n-grams in the sample; tables with a column a language are made for ``GROUP``
    languages at a time."""

    langs: list[str]
    order: int
    symbol: np.ndarray  # byte -> symbol; 0 is a byte never seen, or the start of a text
    shorter: np.ndarray  # node -> node of the context without its oldest byte
    children: tuple[np.ndarray, np.ndarray]  # node * symbols + older symbol -> node
    entries: tuple[np.ndarray, np.ndarray]  # node * symbols + symbol -> entry
    entry_node: np.ndarray
    entry_shorter: np.ndarray  # entry -> the same byte's entry in the shorter context
    entry_levels: list[int]  # first entry of each order, and the end
    hits: tuple[np.ndarray, np.ndarray, np.ndarray]  # entry, language, bits
    escapes: tuple[np.ndarray, np.ndarray, np.ndarray]  # node, language, bits

    def __post_init__(self) -> None:
        self._tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        width = int(self.symbol.max()) + 1
        self.child = Lookup(len(self.shorter), width, *self.children)
        self.entry = Lookup(len(self.shorter), width, *self.entries)

    def tables(self, g: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits of every entry and escapes of every node for the g-th group of languages."""
        if g not in self._tables:
            lo, n = g * GROUP, min(GROUP, len(self.langs) - g * GROUP)
            escape = np.zeros((len(self.shorter), n), np.float32)
            node, lang, bits = self.escapes
            own = (lang >= lo) & (lang < lo + n)
            escape[node[own], lang[own] - lo] = bits[own]
            cost = np.zeros((len(self.entry_node), n), np.float32)
            entry, lang, bits = self.hits
            own = (lang >= lo) & (lang < lo + n)
            cost[entry[own], lang[own] - lo] = bits[own]
            seen = np.zeros(cost.shape, bool)
            seen[entry[own], lang[own] - lo] = True
            for k, (a, b) in enumerate(zip(self.entry_levels, self.entry_levels[1:])):
                below = cost[self.entry_shorter[a:b]] if k else np.float32(8)
                cost[a:b] = np.where(seen[a:b], cost[a:b], escape[self.entry_node[a:b]] + below)
            self._tables = {g: (cost, escape)}  # one group at a time
        return self._tables[g]

    def bits(self, texts: list[np.ndarray]) -> np.ndarray:
        """Exact code lengths: a row for each text, a column for each language."""
        out = np.zeros((len(texts), len(self.langs)))
        for g in range(-(-len(self.langs) // GROUP)):
            columns = out[:, g * GROUP : (g + 1) * GROUP]
            group, held = [], 0
            for i, t in enumerate(texts):
                group.append(i)
                held += len(t) + self.order
                if held >= SLICE or i == len(texts) - 1:
                    self._bits(texts, group, columns, *self.tables(g))
                    group, held = [], 0
        return out

    def _bits(self, texts: list[np.ndarray], group: list[int], out: np.ndarray, table: np.ndarray, escape: np.ndarray) -> None:
        start = np.zeros(self.order, self.symbol.dtype)
        joined = np.concatenate([p for i in group for p in (start, self.symbol[texts[i]])])
        owner = np.repeat(np.array(group), [len(texts[i]) + self.order for i in group])
        firsts = np.flatnonzero(np.diff(owner, prepend=-1))
        step = max(1 << 14, SLICE * 4 // table.shape[1])
        for a in range(0, len(joined), step):
            b = min(len(joined), a + step)
            node = best = np.ones(b - a, np.int32)
            for k in range(1, self.order + 1):
                older = np.zeros(b - a, self.symbol.dtype)
                lo = max(0, k - a)
                older[lo:] = joined[a - k + lo : b - k]
                node = self.child(node, older)
                best = np.where(node > 0, node, best)
            entry = self.entry(best, joined[a:b])
            cost = table[entry]
            left, at = np.flatnonzero(entry == 0), best
            at = at[left]
            while len(left):  # escape to the shorter contexts, at last to 8 bits
                cost[left] += escape[at] + np.where(at == 1, np.float32(8), np.float32(0))[:, None]
                left, at = left[at > 1], self.shorter[at[at > 1]]
                entry = self.entry(at, joined[a:b][left])
                cost[left] += table[entry]
                left, at = left[entry == 0], at[entry == 0]
            real = np.ones(b - a, bool)
            for k in range(self.order):
                pad = firsts + k - a
                real[pad[(pad >= 0) & (pad < b - a)]] = False
            cost[~real] = 0
            runs = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
            np.add.at(out, owner[a:b][runs], np.add.reduceat(cost, runs, axis=0, dtype=np.float64))


def build_model(langs: list[str], lang_ix: np.ndarray, grams: np.ndarray, counts: np.ndarray, order: int, min_count: int) -> PpmModel:
    """From counts of byte (order + 1)-grams (big-endian in an integer; byte 0 is before the text).

    One order at a time, in memory that follows the number of n-grams."""
    cells = np.stack([(grams >> np.uint64(8 * (order - j))) & np.uint64(255) for j in range(order + 1)], 1).astype(np.uint8)
    seen = np.unique(cells[cells > 0])
    symbol = np.zeros(256, np.int16)
    symbol[seen] = np.arange(1, len(seen) + 1)
    cells, s, n_lang = symbol[cells], len(seen) + 1, len(langs)
    shorter, child_keys, child_nodes = [np.zeros(2, np.int64)], [], []
    entry_keys, entry_nodes, entry_shorter, levels = [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [1]
    hits, escapes = [], []
    node_of = np.ones(len(cells), np.int64)  # each gram's node of the order before; 0: none
    entry_of = np.zeros(len(cells), np.int64)
    n_nodes, n_entries = 2, 1
    for k in range(order + 1):
        if k:  # the context that is one byte longer, where the shorter one is a node
            older = cells[:, order - k].astype(np.int64)
            key = np.where((node_of > 0) & (older > 0), node_of * s + older, 0)
            keys, index, total = _totals(key, counts)
            kept = (keys > 0) & ((total >= min_count) | (k < 3))
            number = np.where(kept, n_nodes - 1 + np.cumsum(kept), 0)
            if not kept.any():
                break
            child_keys.append(keys[kept])
            child_nodes.append(number[kept])
            shorter.append(keys[kept] // s)
            n_nodes += int(kept.sum())
            node_of = number[index]
        use = node_of > 0
        keys, index, _ = _totals(node_of[use] * s + cells[use, order], counts[use])
        entry_keys.append(keys)
        entry_nodes.append(keys // s)
        below = np.zeros(len(keys), np.int64)
        below[index] = entry_of[use]
        entry_shorter.append(below)
        entry_of = np.zeros(len(cells), np.int64)
        entry_of[use] = n_entries + index
        pair, where, n = _totals(entry_of[use] * n_lang + lang_ix[use], counts[use])
        entry, lang = pair // n_lang, pair % n_lang
        node = (keys // s)[entry - n_entries]
        at, index, total = _totals(node * n_lang + lang, n)
        distinct = np.bincount(index, minlength=len(at)).astype(float)
        hits.append((entry, lang, -np.log2(n / (total + distinct)[index])))
        escapes.append((at // n_lang, at % n_lang, -np.log2(distinct / (total + distinct))))
        n_entries += len(keys)
        levels.append(n_entries)
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    sparse = lambda parts: tuple(join([p[c] for p in parts], kind) for c, kind in enumerate((np.int32, np.int32, np.float32)))
    entries = join(entry_keys, np.int64)
    return PpmModel(
        langs, order, symbol, join(shorter, np.int32), (join(child_keys, np.int64), join(child_nodes, np.int32)),
        (entries, np.arange(1, len(entries) + 1, dtype=np.int32)), join(entry_nodes, np.int32), join(entry_shorter, np.int32), levels,
        sparse(hits), sparse(escapes))


def _totals(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, index = np.unique(key, return_inverse=True)
    return keys, index, np.bincount(index, counts, len(keys))


def held_out(id_col: str) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, mod 3, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def count_grams(order: int):
    def run(batches):
        for batch in batches:
            found = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found.setdefault(lang, []).append(folded(text))
            for lang, texts in found.items():
                pad = np.zeros(order, np.uint8)
                x = np.concatenate([p for t in texts for p in (pad, t)]).astype(np.uint64)
                if len(x) <= order:
                    continue
                key = np.zeros(len(x) - order, np.uint64)
                for j in range(order + 1):
                    key = (key << np.uint64(8)) | x[j : len(x) - order + j]
                key, n = np.unique(key[x[order:] > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(n, pa.int64())],
                    ["lang", "gram", "n"],
                )

    return run


def train(
    docs: DataFrame, train_docs: int = 1000, train_bytes: int = 64_000_000, longest: int = 1_000_000, order: int = 4, min_count: int = 2,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> PpmModel:
    """Learn every language from a bounded sample of the rows that are not held out.

    About ``train_docs`` rows a language are drawn, fewer if all languages together would exceed ``train_bytes`` bytes; texts
    of more than ``longest`` bytes are not drawn. Rows are drawn by a hash of id and text, so the sample does not depend
    on partitions. Rows with a null text or language teach nothing; every other value of the language
    column that the sample holds is learnt, however many there are."""
    labelled = docs.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), held_out(id_col).alias("held"),
    ).where("lang is not null and text is not null and not held")
    labelled = labelled.withColumn("size", F.octet_length("text")).where(F.col("size") <= longest)
    per = cut(labelled.groupBy("lang").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")))
    n_lang = max(1, per.count())
    share = per.select("lang", F.least(train_docs / F.col("rows"), train_bytes / n_lang / F.greatest("bytes", F.lit(1))).alias("share"))
    share = F.broadcast(share) if n_lang <= 100_000 else share  # one row a language
    text_hash = F.crc32(F.col("text").cast("binary")).cast("string")
    drawn = F.crc32(F.concat(F.lit("sample:"), F.col("key"), F.lit(":"), text_hash).cast("binary")) / float(1 << 32)
    sample = labelled.join(share, "lang").where(drawn < F.col("share")).select("lang", "text")
    counted = (
        sample.mapInArrow(count_grams(order), "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    )
    if not counted.num_rows:
        none = np.zeros(0, np.int64)
        return build_model([], none, none.astype(np.uint64), none.astype(float), order, min_count)
    coded = pc.dictionary_encode(counted.column("lang").combine_chunks())
    langs = coded.dictionary.to_pylist()
    place = np.argsort(np.argsort(np.array(langs)))
    lang_ix = place[coded.indices.to_numpy()].astype(np.int64)
    grams = counted.column("gram").to_numpy().astype(np.uint64)
    return build_model(sorted(langs), lang_ix, grams, counted.column("n").to_numpy().astype(np.float64), order, min_count)


_opened: dict[int, PpmModel] = {}


def _open(value: tuple) -> PpmModel:
    """The model of a broadcast value, made once in a worker."""
    if id(value) not in _opened:
        _opened.clear()
        _opened[id(value)] = PpmModel(*value)
    return _opened[id(value)]


def identify(docs: DataFrame, model: PpmModel, text_col: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``pred`` and ``score`` (replaced if they exist).

    Null texts, texts without a letter and, if nothing was learnt, all texts are ``und`` with
    score 0. Equal code lengths go to the language first by name."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tuple(getattr(model, f.name) for f in fields(model)))
    rest = docs.drop(pred, score)
    schema = StructType([*rest.schema.fields]).add(pred, "string").add(score, "double")

    def run(batches):
        m = _open(shared.value)
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                texts = batch.column(text_col).to_pylist()
                ok = [i for i, t in enumerate(texts) if m.langs and has_letter(t)]
                bits = m.bits([folded(texts[i]) for i in ok])
                names, scores = ["und"] * len(texts), [0.0] * len(texts)
                if ok:
                    best = bits.argmin(1)
                    odds = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000.0)).sum(1)
                    for i, j, o in zip(ok, best.tolist(), odds.tolist()):
                        names[i], scores[i] = m.langs[j], 1.0 / o
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    [*batch.schema.names, pred, score],
                )

    return rest.mapInArrow(run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document (see ``train`` and ``identify``)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
