"""Embedding near-duplicates with randomised-rotation binary codes.

Vectors of the same label and a cosine of at least ``THRESHOLD`` are linked. A unit vector x is
padded to a power of two and rotated by random sign flips and Hadamard transforms; its code is the signs of the result, and
``f = <rotated x, code / sqrt(D)>`` is stored with it. ``<rotated q, code> / f`` is then an unbiased
estimate of the cosine of q and x, with an error of about
``sqrt(1 - f^2) / f * sqrt(1 - cos^2) / sqrt(D - 1)`` times a standard normal; a pair whose estimate plus
``SIGMAS`` of these, at the threshold's cosine, stays below the threshold cannot be a link, every other pair is recomputed exactly
in double precision.

Candidates come from the same kind of rotation: in each of T tables a vector's key is the
largest coordinate, with its sign, under ``m`` further rotations. m follows from the largest
label so that buckets stay small, T from m so that a pair at the threshold shares no key with
probability ``MISS`` at most; both work alike at every size.

Equal vectors are one node. Within a bucket the pairs that the estimates let through are compared in 8 bits, whose error
has a strict bound, and the nodes reduced to stars, and these to components, which so hold hardly a pair under the threshold; in every component all pairs are estimated and, where needed, recomputed in
pairs of blocks (see ``blocks``); only counts and roots leave the tasks.
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
from .words import mixed

THRESHOLD = 0.93
SIGMAS = 5.0
MISS = 1e-5
BUCKET_NODES = 64
BLOCK_ROWS = 1024
BUCKET_ROWS = 8192


#: Rotations up to this many numbers are kept as one matrix; beyond, each is computed as it is needed.
MATRIX = 1 << 22
_rotations: dict[tuple[int, int, int], np.ndarray] = {}


def padded(dims: int) -> int:
    return 1 << max(0, dims - 1).bit_length()


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows (their length is a power of two), without a factor."""
    n, p = x.shape
    step = 1
    while step < p:
        y = x.reshape(n, p // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, p)
        step *= 2
    return x


def _spin(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th rotation of rows that are padded to a power of two: three random sign flips, each with a transform."""
    p = x.shape[1]
    flips = np.random.default_rng([11, p, k]).integers(0, 2, (3, p)) * 2.0 - 1.0
    for f in flips:
        x = _hadamard(x * f) / math.sqrt(p)
    return x


def rotated(x: np.ndarray, first: int, last: int) -> np.ndarray:
    """Rows under the rotations first..last-1: rows x rotations x padded dimensions.

    A rotation costs p log p steps a row and 3 p signs, so neither time nor memory grows with the square of the dimensions."""
    n, dims = x.shape
    p, count = padded(dims), last - first
    if dims * p * count > MATRIX:
        wide = np.zeros((n, p))
        wide[:, :dims] = x
        return np.stack([_spin(wide, k) for k in range(first, last)], 1)
    key = (dims, first, last)
    if key not in _rotations:
        _rotations[key] = np.concatenate([_spin(np.eye(dims, p), k) for k in range(first, last)], 1)
    return (x @ _rotations[key]).reshape(n, count, p)


def meeting(dims: int, threshold: float) -> float:
    """The chance that a pair at the threshold has the same largest coordinate and sign."""
    dims = padded(dims)
    rng = np.random.default_rng([12, dims])
    x = rng.standard_normal((20_000, dims))
    y = threshold * x + math.sqrt(1 - threshold**2) * rng.standard_normal((20_000, dims))
    a, b = np.abs(x).argmax(1), np.abs(y).argmax(1)
    rows = np.arange(len(x))
    return max(float(((a == b) & (x[rows, a] * y[rows, b] > 0)).mean()), 0.01)


def plan(largest: int, dims: int, threshold: float) -> tuple[int, int]:
    """(m, T) for labels of up to ``largest`` vectors."""
    m = max(1, math.ceil(math.log(max(largest, 1) / BUCKET_NODES) / math.log(2 * padded(dims) + 1)))
    p = meeting(dims, threshold) ** m
    return m, math.ceil(math.log(MISS) / math.log(1 - p)) if p < 1 else 1


def bucket_keys(x: np.ndarray, labels: list[str], m: int, tables: int) -> np.ndarray:
    """A row of keys for each unit vector."""
    n, dims = x.shape
    key = np.array([xxhash.xxh3_64_intdigest(f"{dims}:{v}") for v in labels], np.uint64)
    out = np.zeros((n, tables), np.uint64)
    for a in range(0, n, 256):
        k = np.repeat(key[a : a + 256, None], tables, 1) + np.arange(1, tables + 1, dtype=np.uint64)
        some = max(1, (1 << 20) // (256 * padded(dims) * m))  # tables at a time
        for t in range(0, tables, some):
            u = min(tables, t + some)
            z = rotated(x[a : a + 256], 1 + t * m, 1 + u * m).reshape(-1, u - t, m, padded(dims))
            top = np.abs(z).argmax(3)
            sign = np.take_along_axis(z, top[..., None], 3)[..., 0] > 0
            symbol = (2 * top + sign + 1).astype(np.uint64)
            for c in range(m):
                k[:, t:u] = mixed(k[:, t:u] * np.uint64(0x9E3779B97F4A7C15) + symbol[:, :, c])
        out[a : a + 256] = k
    return out.view(np.int64)


def codes(x: np.ndarray) -> np.ndarray:
    """A row of bytes a unit vector: rotated in 8 bits, the step of these, the correction factor."""
    z = rotated(x, 0, 1)[:, 0]
    step = np.maximum(np.abs(z).max(1), 1e-30) / 127
    f = np.abs(z).sum(1) / math.sqrt(z.shape[1])
    small = np.rint(z / step[:, None]).astype(np.int8)
    return np.concatenate([small.view(np.uint8), np.stack([step, f], 1).astype(np.float32).view(np.uint8)], 1)


class Estimates:
    """Estimated cosines and their bounds from rows of codes."""

    def __init__(self, rows: np.ndarray, threshold: float):
        self.dims = rows.shape[1] - 8
        small = np.ascontiguousarray(rows[:, : self.dims]).view(np.int8)
        step, self.f = np.ascontiguousarray(rows[:, self.dims :]).view(np.float32).T.astype(np.float64)
        self.q = small * step[:, None]
        self.b = np.where(small >= 0, 1.0, -1.0) / math.sqrt(self.dims)
        rounding = step * math.sqrt(self.dims) / 2 / self.f
        off = np.sqrt(np.maximum(1 - self.f**2, 0)) / self.f * math.sqrt(1 - threshold**2)
        off = SIGMAS * off / math.sqrt(self.dims - 1) if self.dims > 1 else off + 2
        self.least = threshold - off - 2 * rounding - 1e-6
        self.off, self.threshold = step * math.sqrt(self.dims) / 2, threshold

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = np.empty(len(i), bool)
        for a in range(0, len(i), 1 << 15):
            x, y = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
            some = np.einsum("ij,ij->i", self.q[x], self.b[y]) / self.f[y] >= self.least[y]
            x, y = x[some], y[some]  # what is left is compared in 8 bits, whose error has a strict bound
            error = self.off[x] + self.off[y] + self.off[x] * self.off[y] + 1e-6
            some[some] = np.einsum("ij,ij->i", self.q[x], self.q[y]) >= self.threshold - error
            ok[a : a + (1 << 15)] = some
        return ok

    def block(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        return self.q[rows] @ self.b[cols].T / self.f[cols] >= self.least[cols]


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each row's vector in double precision; None if it can link with nothing."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.array(column.value_lengths().fill_null(0).to_pylist(), np.int64)
    ends = np.cumsum(sizes)
    out = []
    for n, end in zip(sizes.tolist(), ends.tolist()):
        v = flat[end - n : end]
        norm = np.linalg.norm(v) if n else 0.0
        out.append(v if n and np.isfinite(v).all() and norm > 0 and np.isfinite(norm) else None)
    return out


def _prepare(m: int, tables: int):
    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                labels = batch.column("label").to_pylist()
                vectors = _vectors(batch.column("vector"))
                digest, raw, key, code = ([None] * len(labels) for _ in range(4))
                by_dims: dict[int, list[int]] = {}
                for k, (label, v) in enumerate(zip(labels, vectors)):
                    if label is not None and v is not None:
                        by_dims.setdefault(len(v), []).append(k)
                for own in by_dims.values():
                    x = np.stack([vectors[k] for k in own]) + 0.0  # no negative zeros
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    keys, rows = bucket_keys(unit, [labels[k] for k in own], m, tables), codes(unit)
                    for r, k in enumerate(own):
                        raw[k] = x[r].tobytes()
                        digest[k] = xxhash.xxh3_128_digest(labels[k].encode() + b"\0" + raw[k])
                        key[k], code[k] = keys[r], rows[r].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(digest, pa.binary()), pa.array(raw, pa.binary()), pa.array(code, pa.binary()),
                     pa.array(key, pa.list_(pa.int64()))], ["id", "digest", "raw", "code", "keys"])

    return run


def _runs(t: pa.Table, first: np.ndarray, column: str):
    """Parts of the table whose codes have one length, with their group starts; groups never mix lengths."""
    sizes = np.array([len(x) for x in t.column(column).to_pylist()])
    ends = np.append(first[1:], t.num_rows)
    a = 0
    for g in range(len(first)):
        if g + 1 == len(first) or sizes[first[g + 1]] != sizes[first[a]]:
            yield first[a], ends[g], first[a : g + 1] - first[a]
            a = g + 1


def _bucket_stars(threshold: float):
    def run(batches):
        for t, first in groups(batches, ("key", "lo", "hi")):
            for lo, hi, starts in _runs(t, first, "code"):
                part = t.slice(lo, hi - lo)
                node, width = part.column("node"), len(part.column("code")[0].as_py())
                e = Estimates(byte_rows(part.column("code"), width), threshold)
                a, b = stars(len(node), starts, e.pairs, e.block)
                yield pa.RecordBatch.from_arrays([node.take(a).combine_chunks(), node.take(b).combine_chunks()], ["a", "b"])

    return run


def _verify(threshold: float):
    def run(batches):
        for t, first in groups(batches, ("key", "lo", "hi"), rows=1024):
            node, copies = t.column("node"), t.column("copies").to_numpy()
            block, los, his = (t.column(c).to_numpy() for c in ("block", "lo", "hi"))
            raw, code = t.column("raw").to_pylist(), t.column("code").to_pylist()
            links, root = np.zeros(len(node), np.int64), np.arange(len(node))
            for a, b in zip(first.tolist(), np.append(first[1:], len(node)).tolist()):
                v = np.stack([np.frombuffer(x, np.float64) for x in raw[a:b]])
                norm = np.linalg.norm(v, axis=1)
                e = Estimates(np.stack([np.frombuffer(x, np.uint8) for x in code[a:b]]), threshold)
                inner = los[a] == his[a]
                rows = np.arange(b - a) if inner else np.flatnonzero(block[a:b] == los[a])
                cols = np.arange(b - a) if inner else np.flatnonzero(block[a:b] == his[a])
                linked = np.zeros((b - a, b - a), bool)
                for s in range(0, len(rows), 256):
                    r = rows[s : s + 256]
                    i, j = np.nonzero(e.block(r, cols) & ((r[:, None] < cols[None]) if inner else True))
                    i, j = r[i], cols[j]
                    for c in range(0, len(i), 1 << 15):
                        x, y = i[c : c + (1 << 15)], j[c : c + (1 << 15)]
                        ok = np.einsum("ij,ij->i", v[x], v[y]) / (norm[x] * norm[y]) >= threshold
                        linked[x[ok], y[ok]] = True
                linked |= linked.T
                links[a:b] = linked.astype(np.float64) @ copies[a:b]
                root[a:b] = a + first_rows(linked)
            yield pa.RecordBatch.from_arrays(
                [node.combine_chunks(), pa.array(links), node.take(root).combine_chunks(), t.column("parts").combine_chunks()],
                ["node", "links", "root", "parts"])

    return run


def cosine_classes(
    vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """One row per row: id, n_links (other rows linked directly, copies included), component_id
    (the smallest id reachable), kept (it is the component's own id).

    Null labels, null ids and vectors that are null, empty, zero or hold a null, an infinity or no number link with
    nothing; so do vectors of different lengths with each other. Nodes are (id, digest of label and vector), so rows that repeat
    an id are judged each by its own vector. An empty table gives an empty result. Other columns are dropped."""
    read = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    largest, dims = (
        read.where("label is not null and size(vector) > 0").groupBy("label", F.size("vector").alias("dims")).count()
        .agg(F.max("count"), F.max("dims")).first()
    )
    m, tables = plan(largest or 1, dims or 1, threshold)
    signed = cut(read.mapInArrow(_prepare(m, tables), "id long, digest binary, raw binary, code binary, keys array<long>"))
    nodes = cut(
        signed.where("digest is not null and id is not null").groupBy("digest")
        .agg(F.min("id").alias("id"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("raw", "code", "keys")])
        .withColumn("node", node_key("id", "digest"))
    )
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = keyed.join(shared, "key").join(nodes.select("node", "code"), "node")
    edges = deal_blocks(met, "key", F.ceil(F.col("size") / BUCKET_ROWS), "node").select("key", "lo", "hi", "node", "code").mapInArrow(
        _bucket_stars(threshold), "a binary, b binary")
    found = components(edges)
    members = found.select("node", F.col("root").alias("key")).unionByName(
        found.select(F.col("root").alias("node"), F.col("root").alias("key")).distinct())
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    rows = members.join(sizes, "key").join(nodes.select("node", "copies", "raw", "code"), "node")
    verified = cut(
        deal_blocks(rows, "key", F.col("parts"), "node")
        .select("key", "lo", "hi", "block", "node", "copies", "raw", "code", "parts")
        .mapInArrow(_verify(threshold), "node binary, links long, root binary, parts int")
    )
    links = verified.groupBy("node").agg(F.sum("links").alias("links"), F.max("parts").alias("parts"), F.first("root").alias("own"))
    # a component that was one block knows its roots; only those of several blocks need to be connected
    joined = components(verified.where("parts > 1").select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = links.join(joined, "node", "left").select(
        "node", "links", F.coalesce("root", F.when(F.col("parts") == 1, F.col("own")), "node").alias("root"))
    special = (
        nodes.select("digest", "node", "copies").join(linked, "node", "left")
        .where("copies > 1 or links > 0")
        .select("digest", node_id(F.coalesce("root", "node")).alias("class"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    return (
        signed.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest"))
        .join(special, "digest", "left")
        .select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                F.coalesce("class", "id").alias("component_id"),
                F.coalesce(F.col("class") == F.col("id"), F.lit(True)).alias("kept"))
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector (see ``cosine_classes``)."""
    return cosine_classes(table(spark, sf_dir, "embeddings"))


OP4_SQL = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= {THRESHOLD}),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links,
  least(vec_id, coalesce((SELECT min(y) FROM reach WHERE x = vec_id), vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce((SELECT min(y) FROM reach WHERE x = vec_id), vec_id)) AS kept
FROM embeddings
"""
