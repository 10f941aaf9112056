"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of runs of five words. Links are pairs with a Jaccard similarity of at least
0.8; classes are what links connect. Steps:

1. One narrow pass gives each text a digest of its words, ``HASHES`` MinHash values (their
   lowest byte is kept for comparing, the full values make the band keys). Texts with the same
   words are one node from here on, so groups of copies cost one row.
2. Nodes that share a band key are candidates (25 bands of 5: a pair at 0.8 is missed with
   probability 5e-5). Within a bucket MinHash bytes are compared 32 at a time; a pair is dropped as soon as
   the posterior probability of reaching 0.8, from a uniform prior, is below ``TOLERANCE``. What
   is left is reduced to stars, and these to candidate components.
3. In every component all pairs are compared the same way and the pairs that are left are
   verified exactly on their shingle sets, in pairs of blocks (see ``blocks``). The tasks return for each node
   its number of links and its root, never pairs.
4. The verified roots are joined to classes and handed to all copies.

Only nodes with candidates read their text again, and only these nodes' shingles are shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import byte_rows, deal_blocks, first_rows, groups, stars
from .common import cut, node_id, node_key, table
from .graph import components
from .words import mixed, shingles, words

WIDTH = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 25, 5
HASHES = 128
STEP = 32
TOLERANCE = 1e-6
BLOCK_ROWS = 1024
BLOCK_BYTES = 32_000_000
BUCKET_ROWS = 8192

_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def minhash(sh: np.ndarray) -> np.ndarray:
    """``HASHES`` values of 32 bits."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(sh), 2048):
        low = np.minimum(low, (_MUL[:, None] * sh[None, a : a + 2048] + _ADD[:, None]).min(1))
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(values: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    rows = values[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    for j in range(BAND_ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 32, 64, ... compared bytes, the fewest matches with a posterior of ``tolerance`` or more.

    Bytes agree with probability r = J + (1 - J) / 256; under a uniform prior the posterior
    P(r >= x | m of n) is the chance of at most m successes in n + 1 draws at x."""
    x = threshold + (1 - threshold) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * x**m * (1 - x) ** (n + 1 - m)
        out.append(m)
    return out


_LEAST = least_matches()


def likely(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) survive the incremental comparison."""
    out = np.ones(len(i), bool)
    for a in range(0, len(i), 1 << 16):
        live = np.arange(a, min(len(i), a + (1 << 16)))
        seen = np.zeros(len(live), np.int64)
        for k, least in enumerate(_LEAST):
            part = slice(k * STEP, (k + 1) * STEP)
            seen += (sig[i[live], part] == sig[j[live], part]).sum(1)
            ok = seen >= least
            out[live[~ok]] = False
            live, seen = live[ok], seen[ok]
    return out


def early(sig: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Which pairs of rows x cols survive the first step of the comparison."""
    head = np.ascontiguousarray(sig[cols, :STEP])
    out = np.empty((len(rows), len(cols)), bool)
    for a in range(0, len(rows), 32):
        out[a : a + 32] = (sig[rows[a : a + 32], None, :STEP] == head[None]).sum(2, dtype=np.uint8) >= _LEAST[0]
    return out


def likely_block(sig: np.ndarray, rows: np.ndarray, cols: np.ndarray, inner: bool) -> tuple[np.ndarray, np.ndarray]:
    """The surviving pairs of rows x cols; if both are the same block (``inner``), those with row < col."""
    left, right = [], []
    for a in range(0, len(rows), 32):
        r = rows[a : a + 32]
        i, j = np.nonzero(early(sig, r, cols) & ((r[:, None] < cols[None]) if inner else True))
        i, j = r[i], cols[j]
        ok = likely(sig, i, j)
        left.append(i[ok])
        right.append(j[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def sign(id_col: str, row_col: str, text_col: str):
    """id, row, digest (null without a word), number of shingles, sig, bands of every text."""

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                digests, sizes, sigs, bands = [], [], [], []
                for text in batch.column(text_col).to_pylist():
                    tokens = words(text)
                    if not tokens:
                        digests.append(None), sizes.append(0), sigs.append(None), bands.append(None)
                        continue
                    sh = shingles(tokens, WIDTH)
                    values = minhash(sh)
                    sizes.append(len(sh))
                    digests.append(xxhash.xxh3_128_digest(" ".join(tokens)))
                    sigs.append((values & np.uint32(255)).astype(np.uint8).tobytes())
                    bands.append(band_keys(values))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col), batch.column(row_col), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                     pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "row", "digest", "n", "sig", "bands"])

    return run


def _bucket_stars(batches):
    for t, first in groups(batches, ("key", "lo", "hi")):
        sig, node = byte_rows(t.column("sig"), HASHES), t.column("node")
        a, b = stars(t.num_rows, first, lambda i, j: likely(sig, i, j), lambda r, c: early(sig, r, c))
        yield pa.RecordBatch.from_arrays([node.take(a).combine_chunks(), node.take(b).combine_chunks()], ["a", "b"])


def _shingled(batches):
    for whole in batches:
        for a in range(0, whole.num_rows, 1024):
            batch = whole.slice(a, 1024)
            sets = [shingles(words(x), WIDTH).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(c for c, n in zip(batch.columns, batch.schema.names) if n != "text"), pa.array(sets, pa.binary())],
                [*(n for n in batch.schema.names if n != "text"), "shingles"],
            )


def exact(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least ``threshold``, exactly."""
    n = np.array([len(s) for s in sets])
    if len(i) <= 64 or len(i) < 2 * len(sets):
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    else:  # counts of common shingles by products of incidence matrices, some columns at a time
        owner = np.repeat(np.arange(len(sets)), n)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times >= 2
        number = np.cumsum(shared) - 1
        use = shared[column]
        owner, column = owner[use], number[column[use]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for a in range(0, int(shared.sum()), 2048):
            lo, hi = np.searchsorted(column, (a, a + 2048))
            x = np.zeros((len(sets), 2048), np.float32)
            x[owner[lo:hi], column[lo:hi] - a] = 1
            common += x @ x.T
        both = common[i, j].astype(np.int64)
    return both >= threshold * (n[i] + n[j] - both) - 1e-9


def _verify(batches):
    for t, first in groups(batches, ("key", "lo", "hi"), rows=512):
        node, copies = t.column("node"), t.column("copies").to_numpy()
        block, lo, hi = (t.column(c).to_numpy() for c in ("block", "lo", "hi"))
        sig = byte_rows(t.column("sig"), HASHES)
        raw = t.column("shingles")
        links, root = np.zeros(len(node), np.int64), np.arange(len(node))
        for a, b in zip(first, np.append(first[1:], len(node))):
            rows = np.arange(a, b)
            if lo[a] == hi[a]:
                i, j = likely_block(sig, rows, rows, True)
            else:
                i, j = likely_block(sig, rows[block[a:b] == lo[a]], rows[block[a:b] == hi[a]], False)
            if not len(i):
                continue
            sets = [np.frombuffer(x, np.uint64) for x in raw.slice(a, b - a).to_pylist()]
            ok = exact(sets, i - a, j - a, THRESHOLD)
            linked = np.zeros((b - a, b - a), bool)
            linked[i[ok] - a, j[ok] - a] = True
            linked |= linked.T
            links[a:b] = linked.astype(np.float64) @ copies[a:b]
            root[a:b] = a + first_rows(linked)
        yield pa.RecordBatch.from_arrays(
            [node.combine_chunks(), pa.array(links), node.take(root).combine_chunks(), t.column("parts").combine_chunks()],
            ["node", "links", "root", "parts"])


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None, broadcast_nodes: int = 300_000) -> DataFrame:
    """One row per row: id, class_id (the smallest id reachable by links), n_links (other rows
    linked directly, copies included), kept (the row is its class's representative), and, under the name ``row``
    if one is given, the checksum ``xxhash64`` of the row's text.

    The representative is the row with the class's smallest id and, if rows with different texts share that id, the
    smallest checksum among the copies; rows that repeat both id and text are all representatives or none.
    Nodes are (id, digest of the words), so rows that repeat an id with different texts are judged each by its own.
    Texts without a word (null, empty, only signs) and rows with a null id link to nothing and
    are a class of their own. Texts of fewer than five words are one run; very long texts are read whole, and blocks
    of ``BLOCK_BYTES`` bound what a task compares. An empty table gives an empty result. Other columns are dropped."""
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("text"))
    signed = cut(read.mapInArrow(sign("id", "row", "text"), "id long, row long, digest binary, n long, sig binary, bands array<long>"))
    nodes = cut(
        signed.where("digest is not null and id is not null").groupBy("digest")
        .agg(F.min(F.struct("id", "row")).alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        .select("digest", "least.id", "least.row", "copies", "n", "sig", "bands").withColumn("node", node_key("id", "digest"))
    )
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = keyed.join(shared, "key").join(nodes.select("node", "sig"), "node")
    edges = deal_blocks(met, "key", F.ceil(F.col("size") / BUCKET_ROWS), "node").select("key", "lo", "hi", "node", "sig").mapInArrow(
        _bucket_stars, "a binary, b binary")
    found = components(edges)
    members = cut(
        found.select("node", F.col("root").alias("key"))
        .unionByName(found.select(F.col("root").alias("node"), F.col("root").alias("key")).distinct())
        .join(nodes.select("node", "copies", "sig", "id", "row", "n"), "node")
    )
    few = members.select("node").limit(broadcast_nodes + 1).count() <= broadcast_nodes
    wanted = members.select("id", "row", "node")
    texts = read.join(F.broadcast(wanted) if few else wanted, ["id", "row"])
    sets = (
        texts.select("node", "text").mapInArrow(_shingled, "node binary, shingles binary")
        .groupBy("node").agg(F.first("shingles").alias("shingles"))
    )
    sizes = members.groupBy("key").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("parts"))
    rows = members.drop("id", "row", "n").join(sizes, "key").join(sets, "node")
    verified = cut(
        deal_blocks(rows, "key", F.col("parts"), "node")
        .select("key", "lo", "hi", "block", "node", "copies", "sig", "shingles", "parts")
        .mapInArrow(_verify, "node binary, links long, root binary, parts int")
    )
    links = verified.groupBy("node").agg(F.sum("links").alias("links"), F.max("parts").alias("parts"), F.first("root").alias("own"))
    # a component that was one block knows its roots; only those of several blocks need to be connected
    joined = components(verified.where("parts > 1").select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = links.join(joined, "node", "left").select(
        "node", "links", F.coalesce("root", F.when(F.col("parts") == 1, F.col("own")), "node").alias("root"))
    special = (
        nodes.select("digest", "node", "copies", "row").join(linked, "node", "left")
        .where("copies > 1 or links > 0")
        .select("digest", node_id(F.coalesce("root", "node")).alias("class"),
                F.when(F.coalesce(F.col("root") == F.col("node"), F.lit(True)), F.col("row")).alias("first"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    return (
        signed.select("id", "row", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest"))
        .join(special, "digest", "left")
        .select(F.col("id").alias(id_col), F.coalesce("class", "id").alias("class_id"),
                F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                F.when(F.col("class").isNull(), True).otherwise(
                    F.coalesce((F.col("class") == F.col("id")) & (F.col("first") == F.col("row")), F.lit(False))).alias("kept"),
                *([F.col("row").alias(row)] if row else []))
    )


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links, kept for every document (see ``jaccard_classes``)."""
    return jaccard_classes(table(spark, sf_dir, "documents"))


#: All pairs that share a run, exactly; documents with the same id would be one here, so ids must be distinct.
OP10_SQL = f"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
runs AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(0, greatest(len(w) - {WIDTH - 1}, 1)), lambda k: hash(array_to_string(w[k + 1:k + {WIDTH}], ' ')))) AS g
  FROM worded WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM runs a JOIN runs b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE common >= {THRESHOLD} * (p.n + q.n - common) - 1e-9),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY 1),
counted AS (SELECT x, count(*) AS n FROM links GROUP BY 1)
SELECT doc_id, least(doc_id, coalesce(least_of.y, doc_id)) AS class_id, coalesce(counted.n, 0) AS n_links,
  doc_id = least(doc_id, coalesce(least_of.y, doc_id)) AS kept
FROM documents LEFT JOIN least_of ON least_of.x = doc_id LEFT JOIN counted ON counted.x = doc_id
"""
