"""Groups of rows compared in blocks, without emitting all pairs.

Large groups are dealt out as pairs of blocks: a row goes to every pair that its block is part
of, so any two rows meet exactly once as (block, block) or inside their block, no task holds
more than two blocks, and only counts and stars leave the task. Rows are sorted by node, so the first row of a
component is its smallest node."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups up to this size are compared pair by pair over many groups at once.
SMALL = 8
#: Rows of a larger group that are compared with the rest of it at a time.
STRIP = 64


def deal_blocks(rows: DataFrame, key: str, blocks: Column, node: str) -> DataFrame:
    """Rows with (block, lo, hi), sorted by (key, lo, hi, node) within partitions; ``blocks`` is the group's number of blocks."""
    n = blocks.cast("int")
    return (
        rows.withColumn("block", F.pmod(F.xxhash64(F.lit(7), node), n).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
        .drop("other")
        .repartition(key, "lo", "hi")
        .sortWithinPartitions(key, "lo", "hi", node)
    )


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int = 8192) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with each group's first row; the input is sorted by the keys."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        first = _firsts(t, keys)
        if first[-1]:
            yield t.slice(0, first[-1]), first[:-1]
            t = t.slice(first[-1])
        held, n = t.to_batches(), t.num_rows
        rows = max(8192, 2 * n)
    if n:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, _firsts(t, keys)


def _firsts(t: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        x = t.column(k).combine_chunks() if isinstance(t.column(k), pa.ChunkedArray) else t.column(k)
        new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def byte_rows(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots, the least of each component, after the edges (a, b)."""
    a, b = root[a], root[b]
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def _least_linked(rows: np.ndarray, alike, screen) -> np.ndarray:
    """For each of a group's rows the place of the first one that links connect it with.

    Rows are compared with all later ones, a strip of 1, 2, 4, ... ``STRIP`` rows at a time, but for the pairs known to be
    connected, so a group of near copies costs its length and any other group a few products of matrices."""
    n, width, a = len(rows), 1, 0
    root = np.arange(n)
    while a < n - 1:
        strip, rest = np.arange(a, min(a + width, n)), np.arange(a, n)
        i, j = np.nonzero((root[strip][:, None] != root[a:][None]) & screen(rows[strip], rows[rest]) & (strip[:, None] < rest[None]))
        i, j = strip[i], rest[j]
        ok = alike(rows[i], rows[j])
        root = _merge(root, i[ok], j[ok])
        a, width = a + len(strip), min(2 * width, STRIP)
        if (root[a:] == root[n - 1]).all():
            break
    return root


def stars(
    n: int, first: np.ndarray, alike: Callable[[np.ndarray, np.ndarray], np.ndarray], screen: Callable[[np.ndarray, np.ndarray], np.ndarray],
) -> tuple[np.ndarray, np.ndarray]:
    """(row, root) for the rows 0..n-1 that the relation ``alike`` connects within their group; root: the component's first row.

    ``alike`` judges pairs of rows, ``screen`` all pairs of two lists at once and must let through whatever is alike."""
    end = np.append(first[1:], n)
    sizes = end - first
    group = np.repeat(np.arange(len(first)), sizes)
    small = (sizes <= SMALL)[group]
    root = np.arange(n)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, SMALL):
        i = np.flatnonzero((group[:-d] == group[d:]) & small[:-d]) if n > d else np.zeros(0, np.int64)
        if not len(i):
            break
        ok = alike(i, i + d)
        left.append(i[ok])
        right.append(i[ok] + d)
    a, b = np.concatenate(left), np.concatenate(right)
    while len(a):  # the least root goes along the edges until nothing changes; at most SMALL steps
        before = root.copy()
        np.minimum.at(root, b, root[a])
        np.minimum.at(root, a, root[b])
        if (before == root).all():
            break
    for g in np.flatnonzero(sizes > SMALL):
        rows = np.arange(first[g], end[g])
        root[rows] = rows[_least_linked(rows, alike, screen)]
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def first_rows(linked: np.ndarray) -> np.ndarray:
    """The first row in each row's component of a symmetric boolean matrix."""
    n = len(linked)
    out, left = np.arange(n), np.ones(n, bool)
    for s in range(n):
        if not left[s]:
            continue
        left[s] = False
        front = np.array([s])
        while len(front):
            out[front] = s
            near = linked[front].any(0) & left
            left[near] = False
            front = np.flatnonzero(near)
    return out
