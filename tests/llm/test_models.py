"""Extraction and language identification: exact against plain versions, accurate on held-out data."""

import html
import math
import re

import numpy as np
import pytest
from conftest import DATA

from lectern.llm import html_extract, language_id
from lectern.llm.common import table
from lectern.llm.html_pages import labelled_pages


@pytest.fixture(scope="module")
def extractor():
    return html_extract.train(labelled_pages())


def brute_marginals(m, f):
    """Sums over all labellings of a small tree."""
    n = len(f.tag)
    own = np.stack([m.tags.get(t, m.other_tag) for t in f.tag]) + m.share[f.share] + m.amount[f.amount]
    for i, words in enumerate(f.words):
        for w in words:
            own[i] = own[i] + m.words.get(w, 0)
    total = np.zeros((n, 3))
    for code in range(3**n):
        y = [code // 3**i % 3 for i in range(n)]
        p = m.root[y[0]] + sum(own[i][y[i]] for i in range(n)) + sum(m.edge[f.kind[i]][y[f.parent[i]]][y[i]] for i in range(1, n))
        for i in range(n):
            total[i][y[i]] += math.exp(p)
    return total / total.sum(1, keepdims=True)


def test_messages_give_exact_marginals(extractor):
    page = html_extract.parse('<div class="menu"><p>some <b>words</b></p><a>x</a></div><main><p>more of them</main>')
    f = html_extract.forest([page])
    assert np.allclose(html_extract.marginals(extractor, f), brute_marginals(extractor, f))


def test_held_out_pages(extractor):
    bad = total = 0
    for source in labelled_pages(200, seed=99):
        p = html_extract.parse(source, labelled=True)
        q = html_extract.marginals(extractor, html_extract.forest([p]))
        for node, text in p.texts:
            if node >= 0 and text.strip():
                total += 1
                bad += (p.label[node] != 0) != (q[node, 0] < 0.5)
    assert bad / total < 0.01


def test_articles_of_the_table(spark, extractor):
    rows = html_extract.op1_html_extract(spark, DATA).join(table(spark, DATA, "pages").select("page_id", "html"), "page_id").collect()
    for r in rows:
        body = re.search(r"<article[^>]*>(.*?)(</article>|$)", r["html"], re.S)[1]
        body = re.sub(r"</?b>", "", re.sub(r"<(?:br|/?(?:p|h\d))\b[^>]*>", " ", body))
        assert r["text"] == " ".join(html.unescape(body).split()) and r["n_chars"] == len(r["text"])


HOSTILE = [
    ("", ""), ("<article><p>a&amp;b &eacute;&#8212;&nbsp;c</p></article>", "a&b é— c"), ("<article><p>one<p>two<br>three</article>", "one two three"),
    ("<article><p>w<b>or</b>d <!-- x > y --> end</article>", "word end"), ('<nav><a href="a>b">menu</a></nav><article><p>text of it</article>', "text of it"),
    ("<article><p>a < b and c</p></article>", "a < b and c"), ("<article><p>long text here<script>var a='</p>';</script> more</p></article>", "long text here more"),
    ("<article><p data=it's>Main text one.</p><p>We don't stop</p></article>", "Main text one. We don't stop"),
    ('<article><p data-y="12.5">text with a mark</p><p data-y="">and more of it</p></article>', "text with a mark and more of it"),
    ("<p>abc and more words</p><select><option>x</option><article><p>the text goes on</p></article>", "abc and more words x the text goes on"),
    ('<article><p>long text here</p><script src="a.js"/>var a=1;</script><p>goes on and on</p></article>', "long text here goes on and on"),
    ("<article><p>see <math><mi>x</mi></math> and <object>the fallback</object> too</p></article>", "see x and the fallback too"),
    ("<article><p>one part <!--> two part <!---> three part <!-- no --!> four part</p></article>", "one part two part three part four part"),
    ("<article><p>text of it</p><!-- left open <p>not this</p> nor this", "text of it"), ("<article><p>text of it</p><!-- left open", "text of it"),
    ("<article><h1>T</h1><p>body text goes on here</p><form><label>Mail</label><input></form></article>", "T body text goes on here"),
]


@pytest.mark.parametrize("source, text", HOSTILE)
def test_hostile_pages(extractor, source, text):
    assert html_extract.extract(extractor, [source]) == [text]


def test_deep_and_broken_pages(extractor):
    html_extract.extract(extractor, ["<div>" * 20000 + "x", "<a " * 50000, '<p class="' * 20000, "</p>" * 20000, "<" * 100000,
                                     "<p><button><b>" + "<div></div>" * 40000, "<head>" * 40000, "<svg>" * 40000, "<a b='" * 40000])


def test_extract_edge_cases(spark, extractor):
    df = spark.createDataFrame([(1, "u", None, "old"), (1, "u", None, "old"), (None, None, "<p>plain", None)], "page_id long, url string, html string, text string")
    got = sorted(html_extract.extract_pages(df, extractor).collect(), key=str)
    assert [(r["text"], r["n_chars"]) for r in got] == [("", 0), ("", 0), ("plain", 5)]
    assert html_extract.extract_pages(df.limit(0), extractor).count() == 0


def plain_bits(samples, lang, text, order, min_count):
    """Prediction by partial matching said plainly, one byte at a time."""
    counts, everywhere = {}, {}
    for name, t in samples:
        t = bytes(language_id.folded(t))
        for i in range(len(t)):
            for k in range(0, min(order, i) + 1):
                everywhere[t[i - k : i]] = everywhere.get(t[i - k : i], 0) + 1
                if name == lang:
                    own = counts.setdefault(t[i - k : i], {})
                    own[t[i]] = own.get(t[i], 0) + 1
    total, t = 0.0, bytes(language_id.folded(text))
    for i in range(len(t)):
        context = t[max(0, i - order) : i]
        while True:
            own = counts.get(context, {})
            if all(everywhere.get(context[j:], 0) >= min_count for j in range(len(context) + 1) if len(context) - j >= 3) and own:
                n, d = sum(own.values()), len(own)
                if t[i] in own:
                    total -= math.log2(own[t[i]] / (n + d))
                    break
                total -= math.log2(d / (n + d))
            if not context:
                total += 8.0
                break
            context = context[1:]
    return total


def test_code_lengths_are_exact():
    samples = [("en", "the theory of the thing"), ("de", "der die das über die dinge"), ("en", "then there"), ("fr", "é")]
    pieces = list(language_id.count_grams(4)([__import__("pyarrow").RecordBatch.from_pydict({"lang": [s[0] for s in samples], "text": [s[1] for s in samples]})]))
    langs = ["de", "en", "fr"]
    ix = np.array([langs.index(x) for b in pieces for x in b.column("lang").to_pylist()])
    grams = np.concatenate([b.column("gram").to_numpy() for b in pieces]).astype(np.uint64)
    n = np.concatenate([b.column("n").to_numpy() for b in pieces]).astype(float)
    m = language_id.build_model(langs, ix, grams, n, 4, 2)
    texts = ["the thing", "über", "x", "der theorie é", "t"]
    got = m.bits([language_id.folded(t) for t in texts])
    want = [[plain_bits(samples, lang, t, 4, 2) for lang in langs] for t in texts]
    assert np.allclose(got, want, atol=1e-3)


def model_of(samples, order=4, min_count=2):
    pieces = list(language_id.count_grams(order)([__import__("pyarrow").RecordBatch.from_pydict({"lang": [s[0] for s in samples], "text": [s[1] for s in samples]})]))
    langs = sorted({s[0] for s in samples})
    ix = np.array([langs.index(x) for b in pieces for x in b.column("lang").to_pylist()])
    grams = np.concatenate([b.column("gram").to_numpy() for b in pieces]).astype(np.uint64)
    return language_id.build_model(langs, ix, grams, np.concatenate([b.column("n").to_numpy() for b in pieces]).astype(float), order, min_count)


def test_long_texts_are_scored_in_slices(monkeypatch):
    m = model_of([("a", "some words and others"), ("b", "andere worte und mehr")])
    texts = [language_id.folded("some words here " * 3000), language_id.folded("x"), language_id.folded("more of it " * 30)]
    whole = m.bits(texts)
    monkeypatch.setattr(language_id, "SLICE", 64)
    assert np.allclose(m.bits(texts), whole, rtol=1e-4)


def test_many_languages_in_groups_and_sparse_tables(spark, monkeypatch):
    """More languages than one group has columns, all learnt, with the same code lengths from dense and from sorted tables."""
    words = {f"l{k:03}": "".join(chr(97 + (k * 7 + j * (k % 5 + 1)) % 26) for j in range(12)) for k in range(90)}
    samples = [(k, f"{w} {w[::-1]} {w[3:9]}") for k, w in words.items()]
    m = model_of(samples)
    texts = [language_id.folded(t) for _, t in samples]
    assert m.langs == sorted(words) and [m.langs[i] for i in m.bits(texts).argmin(1)] == [k for k, _ in samples]
    monkeypatch.setattr(language_id, "DENSE", 0)
    monkeypatch.setattr(language_id, "GROUP", 7)
    assert np.allclose(model_of(samples).bits(texts), m.bits(texts), rtol=1e-5)
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(samples * 3)], "doc_id long, text string, lang string")
    assert len(language_id.train(docs).langs) > 60


def test_held_out_accuracy(spark):
    got = language_id.op2_language_id(spark, DATA).join(table(spark, DATA, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) >= 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(i, "der die das und", "de", 1.0) for i in range(9)] + [(i, "the one and only", "en", 1.0) for i in range(9)], "doc_id long, text string, lang string, score double")
    m = language_id.train(docs)
    more = spark.createDataFrame([(1, None, 2), (2, "123 !", 2), (3, "", 2), (4, "the one", 2), (4, "the one", 2), (5, "日本", 2)], "doc_id long, text string, score int")
    got = sorted((r["doc_id"], r["lang_pred"]) for r in language_id.identify(more, m).collect())
    assert got[:5] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")] and got[5][1] in ("de", "en")
    assert language_id.identify(more.limit(0), m).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(more, language_id.train(docs.limit(0))).collect()} == {"und"}
