"""Near-duplicates, decontamination and the pipeline against brute force."""

import random

import numpy as np
import pytest
from conftest import DATA

from lectern.llm import decontaminate, embedding_dedup, ngram_join
from lectern.llm.common import table
from lectern.llm.words import words


def brute_classes(rows):
    """{id: (class, links)} of (id, text) by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else None)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: (least[find(i)], links[i]) for i, (k, _) in enumerate(rows)}


def test_jaccard_join_on_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, DATA, "documents").collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.op10_ngram_jaccard(spark, DATA).collect()}
    assert got == brute_classes(rows)


def near_copies(n):
    r = random.Random(4)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    out = [(0, " ".join(base))]
    for i in range(1, n):
        text = list(base)
        for _ in range(r.randint(0, 4)):
            text[r.randrange(120)] = f"x{i}"
        out.append((i, " ".join(text)))
    return out + [(1000 + i, " ".join(f"v{r.randrange(900)}" for _ in range(60))) for i in range(40)]


def test_jaccard_join_of_a_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ngram_join, "BUCKET_ROWS", 24)
    rows = near_copies(90)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.jaccard_classes(df, broadcast_nodes=0).collect()}
    assert got == brute_classes(rows)


def test_jaccard_edge_cases(spark):
    rows = [(1, "a b c"), (2, "A b, c!"), (3, None), (4, ""), (5, "..."), (6, "..."), (7, "x " * 3000), (7, "x " * 3000), (None, "a b c")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, node int")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in ngram_join.jaccard_classes(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (3, 3, 0, True), (4, 4, 0, True), (5, 5, 0, True), (6, 6, 0, True),
                          (7, 7, 1, True), (7, 7, 1, True), (None, None, 0, True)], key=str)
    assert ngram_join.jaccard_classes(df.limit(0)).count() == 0


def test_repeated_ids_with_different_texts(spark):
    """(5, A), (5, B), (6, near A), (7, B): each row is judged by its own text."""
    a, b = [f"a{i}" for i in range(100)], " ".join(f"b{i}" for i in range(50))
    near = " ".join(["x", *a[1:]])
    df = spark.createDataFrame([(5, " ".join(a)), (5, b), (6, near), (7, b), (4, near + " y"), (None, b)], "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.jaccard_classes(df).collect()), key=str)
    assert got == sorted([(5, 4, 2, False), (5, 5, 1, True), (6, 4, 2, False), (7, 5, 1, False), (4, 4, 2, True), (None, None, 0, True)], key=str)


def test_posterior_bounds():
    from math import comb

    for n, least in zip(range(32, 129, 32), ngram_join.least_matches()):
        x = 0.8 + 0.2 / 256
        lost = sum(comb(n, m) * x**m * (1 - x) ** (n - m) for m in range(least))
        assert lost < 2e-6


def brute_cosine(rows, threshold=0.93):
    good = {}
    for k, v, label in rows:
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = (np.array(v, float), label)
    link = {k: set() for k, _, _ in rows}
    for a, (x, la) in good.items():
        for b, (y, lb) in good.items():
            if a < b and la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                link[a].add(b)
                link[b].add(a)
    out = {}
    for k in link:
        seen, front = {k}, [k]
        while front:
            front = [y for x in front for y in link[x] - seen]
            seen |= set(front)
        out[k] = (len(link[k]), min(seen))
    return out


def vectors():
    r = np.random.default_rng(3)
    rows, k = [], 0
    for label in range(3):
        for _ in range(6):
            centre = r.standard_normal(64)
            for _ in range(int(r.integers(1, 30))):
                rows.append((k, (centre + 0.25 * r.standard_normal(64)).astype(np.float32).tolist(), label))
                k += 1
    rows += [(k, rows[0][1], 0), (k + 1, rows[0][1], 1), (k + 2, None, 0), (k + 3, [0.0] * 64, 0), (k + 4, [float("nan")] * 64, 0),
             (k + 5, rows[0][1], None), (k + 6, [], 0), (k + 7, [1.0, None], 0), (k + 8, [1.0, 2.0], 0), (k + 9, [2.0, 4.0], 0), (k + 10, [float("inf"), 1.0], 0)]
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_cosine_classes(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    monkeypatch.setattr(embedding_dedup, "BUCKET_ROWS", block)
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.cosine_classes(df).collect()}
    assert got == brute_cosine(vectors())
    assert embedding_dedup.cosine_classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("dims", [3, 64, 96, 1536])
def test_rotations_keep_products(dims, monkeypatch):
    x = np.random.default_rng(2).standard_normal((5, dims))
    one = embedding_dedup.rotated(x, 0, 3)
    assert np.allclose(one[:, 1] @ one[:, 1].T, x @ x.T)
    monkeypatch.setattr(embedding_dedup, "MATRIX", 0 if dims < 1536 else 1 << 40)
    assert np.allclose(embedding_dedup.rotated(x, 0, 3), one)


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(8)
    x = r.standard_normal((3000, 64))
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * r.standard_normal((3000, 64))
    both = np.concatenate([x, y])
    both /= np.linalg.norm(both, axis=1, keepdims=True)
    e = embedding_dedup.Estimates(embedding_dedup.codes(both), 0.93)
    i = np.arange(3000)
    true = (both[i] * both[i + 3000]).sum(1)
    estimate = (e.q[i] * e.b[i + 3000]).sum(1) / e.f[i + 3000]
    assert abs((estimate - true).mean()) < 0.005
    assert e.pairs(i, i + 3000)[true >= 0.93].all()


def brute_tiles(item, doc, least):
    left, right, out = [0] * len(item), [0] * len(doc), []
    while True:
        best = None
        for a in range(len(item)):
            for b in range(len(doc)):
                k = 0
                while a + k < len(item) and b + k < len(doc) and item[a + k] == doc[b + k] and not left[a + k] and not right[b + k]:
                    k += 1
                if k >= least and (best is None or (-k, a, b) < best):
                    best = (-k, a, b)
        if best is None:
            return out
        k, a, b = -best[0], best[1], best[2]
        out.append((a, b, k))
        left[a : a + k] = right[b : b + k] = [1] * k


def test_tiling_is_greedy():
    r = random.Random(3)
    for t in range(300):
        letters = "abc" if t % 2 else "abcdefgh"
        item, doc = ([r.choice(letters) for _ in range(r.randint(1, 25))] for _ in range(2))
        if t % 3:
            doc[5:5] = item[8:] + item[:8]
        want = brute_tiles(item, doc, 3)
        for pairs in (10**6, 0):  # by seed matches, and by hashes of all lengths
            hits = decontaminate.Benchmark.of([(1, " ".join(item))], 3).hits(" ".join(doc), pairs)
            assert want == ([tuple(x[k] for k in ("item_at", "doc_at", "words")) for x in hits[0]["tiles"]] if hits else [])


def test_a_million_equal_words():
    bench = decontaminate.Benchmark.of([(1, "a " * 500), (2, "b " * 20), (3, " ".join(f"w{i}" for i in range(30)))])
    hits = bench.hits("a " * 1_000_000 + " ".join(f"w{i}" for i in range(15)))
    assert [(h["item_id"], h["coverage"]) for h in hits] == [(1, 1.0), (3, 0.5)]


def test_decontamination_of_the_table(spark):
    """Best item, coverage and number of tiles of every document, in both ways, against one search a pair of texts."""
    bench = [tuple(r) for r in table(spark, DATA, "benchmark").select("item_id", "text").collect()]
    want = {}
    for r in table(spark, DATA, "documents").collect():
        own = [(-sum(t[2] for t in tiles) / len(item), i, len(tiles)) for i, t in bench if len(item := words(t)) >= 5
               if (tiles := brute_search(item, words(r["text"])))]
        c, i, n = min(own, default=(0.0, None, 0))
        want[r["doc_id"]] = (c <= -0.5, -c, i, n)
    got = decontaminate.op7_decontaminate(spark, DATA).collect()
    assert {r["doc_id"]: (r["contaminated"], r["coverage"], r["item_id"], r["n_tiles"]) for r in got} == want
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    small = {r["doc_id"]: r["hits"] for r in decontaminate.benchmark_hits(docs, table(spark, DATA, "benchmark")).collect()}
    joined = {r["doc_id"]: r["hits"] for r in decontaminate.benchmark_hits(docs, table(spark, DATA, "benchmark"), part_chars=0).collect()}
    assert small == joined


def brute_search(item, doc, least=5):
    """``brute_tiles``, if the texts share a run at all."""
    runs = {tuple(item[k : k + least]) for k in range(len(item) - least + 1)}
    at = [k for k in range(len(doc) - least + 1) if tuple(doc[k : k + least]) in runs]
    if not at:
        return []
    near = sorted({j for k in at for j in range(k - 1, k + least + 1) if 0 <= j < len(doc)})
    short, last = [], None  # what shares no run is one word that matches nothing
    for j in near:
        short += [doc[j]] if last is None or j == last + 1 else [None, doc[j]]
        last = j
    return brute_tiles(item, short, least)


def test_reordered_passages_and_parts(spark):
    item = " ".join(f"word{i}" for i in range(40))
    half = item.split()
    moved = "Intro words. " + " ".join(half[20:]) + " noise in between " + " ".join(half[:20])
    bench = spark.createDataFrame([(1, item), (2, "one that is short enough"), (3, None), (4, ""), (2, "one that is short enough"), (9, "yes")], "item_id long, text string")
    docs = spark.createDataFrame([(1, moved, 0), (2, "clean text", 0), (3, None, 0), (4, "", 0), (5, "a ONE, that is short enough b yes", 0), (None, "yes", 0), (5, "a ONE, that is short enough b yes", 0)], "doc_id long, text string, hits int")
    seen = []
    for part in (16_000_000, 10):
        got = decontaminate.benchmark_hits(docs, bench, part_chars=part).withColumn("bad", decontaminate.is_contaminated())
        seen.append(sorted(((r["doc_id"], r["bad"], sorted(h["item_id"] for h in r["hits"])) for r in got.collect()), key=str))
    assert seen[0] == seen[1] == [(1, True, [1]), (2, False, []), (3, False, []), (4, False, []), (5, True, [2, 2]), (5, True, [2, 2]), (None, False, [])]
    assert decontaminate.benchmark_hits(docs, bench.limit(0)).where("size(hits) > 0").count() == 0
    assert decontaminate.benchmark_hits(docs.limit(0), bench).count() == 0


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    from lectern.llm import language_id

    docs = table(spark, DATA, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    kept = {k: t for k, t in rows.items() if language_id.has_letter(t)}
    bits = model.bits([language_id.folded(t) for t in kept.values()])
    sure = 1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1) >= corpus_pipeline.LEAST_SCORE
    kept = {k: t for (k, t), s in zip(kept.items(), sure) if s}
    classes = brute_classes(list(kept.items()))
    kept = {k: t for k, t in kept.items() if classes[k][0] == k}
    bench = decontaminate.Benchmark.of([tuple(r) for r in table(spark, DATA, "benchmark").select("item_id", "text").collect()])
    kept = {k: t for k, t in kept.items() if all(h["coverage"] < decontaminate.COVERAGE for h in bench.hits(t))}
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"]: r["text"] for r in got} == kept and len(got) == len(kept)
    for s in range(8):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))


def test_near_duplicate_stage_drops_only_rows_whose_text_is_a_copy(spark):
    import corpus_pipeline

    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (5, a + " x"), (5, b), (7, b + " y"), (7, "clean text of its own"), (8, "twice the same"), (8, "twice the same"), (None, a), (None, a), (9, None), (9, "")]
    df = spark.createDataFrame([(k, t, "en", "s", 0, 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars int, kept int")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_each(spark, df, DATA).collect()), key=str)
    assert got == sorted([(1, a), (5, b), (7, "clean text of its own"), (8, "twice the same"), (None, a), (None, a), (9, None), (9, "")], key=str)


def test_mixture_order_reaches_the_shards(spark):
    import corpus_pipeline
    from lectern.llm.common import cut
    from lectern.llm.mixing import mix

    docs = table(spark, DATA, "documents")
    place = {r["doc_id"]: (r["slot"], r["seq"]) for r in mix(docs).collect()}
    got = corpus_pipeline.into_shards(spark, cut(corpus_pipeline.in_mixture_order(spark, docs, DATA)), DATA).collect()
    for s in range(8):
        own = [place[r["doc_id"]] for r in sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])]
        assert own == sorted(own)


def test_pipeline_stages_take_empty_tables(spark):
    import corpus_pipeline

    docs = table(spark, DATA, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_stars_of_groups_of_all_sizes(seed):
    """Chains, clumps and strangers, in groups below and above the sizes that are compared pair by pair and strip by strip."""
    from lectern.llm.blocks import STRIP, stars

    rng = np.random.default_rng(seed)
    sizes = np.append(rng.integers(1, 12, 20), [STRIP, 3 * STRIP + 5, 700, 1])
    first = np.cumsum(sizes) - sizes
    spread = 10 ** rng.integers(1, 5)
    x = np.concatenate([np.where(rng.random(n) < rng.random(), 5, rng.integers(0, spread, n)) for n in sizes])
    near = lambda i, j: np.abs(x[i] - x[j]) <= 3
    a, b = stars(len(x), first, near, lambda r, c: np.abs(x[r][:, None] - x[c][None]) <= 9)
    got = np.arange(len(x))
    got[a] = b
    for s, n in zip(first, sizes):
        order = s + np.argsort(x[s : s + n], kind="stable")
        part = np.split(order, np.flatnonzero(np.diff(x[order]) > 3) + 1)
        for rows in part:
            assert (got[rows] == rows.min()).all()
