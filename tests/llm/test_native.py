"""Licences, chats, shards, URL rules and mixtures on cases of their own."""

import hashlib
import math
import textwrap
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lectern.llm import chat_format, licenses, mixing, sharding, url_filter

CHAT = "conv_id long, turn long, role string, text string"


def test_chat_round_trip_of_hostile_texts(spark):
    texts = ["\\", "\\\\a", "### User: </turn>\n", "</role>### Other: ", "", None, "a\\c### Assistant: ", "ünï\n\n</turn", "\\n\\\\n"]
    rows = [(1, i, r, t) for i, t in enumerate(texts) for r in ("user", "assistant", "tool", None, "</role>x")]
    got = chat_format.join_turns(chat_format.format_turns(spark.createDataFrame(rows, CHAT))).withColumn("back", chat_format.read_back(F.col("formatted"))).first()
    want = sorted([(i, r or "", t or "") for _, i, r, t in rows])
    assert [(x["role"], x["text"]) for x in got["back"]] == [(r, t) for _, r, t in want]
    assert got["n_turns"] == len(rows) and not got["valid"]


def test_chat_machine_and_loss(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a</turn>"), (2, 0, "assistant", "x"), (3, 0, "user", "q"), (None, None, "user", "n")]
    df = chat_format.join_turns(chat_format.format_turns(spark.createDataFrame(rows, CHAT)))
    got = {r["conv_id"]: (r["valid"], r["loss"]) for r in df.withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert got == {1: (True, "a</turn>"), 2: (False, "x"), 3: (False, ""), None: (False, "")}


def test_chat_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], CHAT + ", segments int, position int")
    assert chat_format.join_turns(chat_format.format_turns(df)).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "a", 3, 4)] * 2, CHAT + ", segments int, position int")
    assert chat_format.join_turns(chat_format.format_turns(df)).first()["n_turns"] == 2


URLS = [None, "", "no scheme", "http://", "http://COM/", "http://com", "https://a.example.com/en/x?q", "https://www.example.com/en/", "https://www.example.com/en",
        "http://xexample.com/en/", "http://b.net/es/#f", "http://net/fr/a/b", "http://net.org/es/", "http://www.example.com/en/a://b", "http://éxample.com/en/", "http://a..com/", "http://company/", "http://companyx/", "http://a.company", "http://xample.com/a", "http://examples.com/"]


def fits(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c)[0]
    host = "".join(x.lower() if "A" <= x <= "Z" else x for x in host)
    best = max(((len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best[2] if best else None, best[3] if best else default


@pytest.mark.parametrize("copies", [5_000_000, 40])
def test_url_rules(spark, copies, monkeypatch):
    rules = [*url_filter.RULES, ("com", "/en", "block"), ("net", "/es/a/", "allow"), ("b.net", "/", "block"), ("company", "", "block"), ("org", "", "block"), ("xample.com", "", "block"), ("example.com", "/en/x", "allow"), ("www.example.com", "/", "allow")]
    pages = spark.createDataFrame([(i % 14, u, "x") for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, host string")
    monkeypatch.setattr(url_filter, "QUESTIONS", 3)
    got = url_filter.url_verdicts(pages, url_filter.rules_frame(spark, rules), max_rule_copies=copies)
    want = [(i % 14, *fits(u, rules)) for i, u in enumerate(URLS + URLS[:2])]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_url_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.url_verdicts(none, url_filter.rules_frame(spark, url_filter.RULES)).count() == 0
    no_rules = spark.createDataFrame([], "host string, path string, verdict string")
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filter.url_verdicts(one, no_rules).first()["verdict"] == "allow"


def test_license_variants(spark):
    mit = licenses.TEXTS[0][1]
    texts = ["Copyright (c) 2024 Somebody\n\n" + mit.upper().replace("\n", " "), "released under THE  mit licence!!", "x\nLicensed under the Apache License, v2.0\n© 2020 A",
             "", None, "All rights reserved.", mit + " extra", "This software is licenced under the GNU General Public License, version 3."]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    got = {r["doc_id"]: (r["license"], r["line_licenses"], r["copyright_lines"]) for r in licenses.scan(df, licenses.known_digests(spark)).collect()}
    assert got[0][0] == "MIT" and got[1][:2] == ("MIT", "MIT") and got[2] == (None, "Apache-2.0", 1)
    assert got[3] == got[4] == (None, "", 0) and got[5] == (None, "", 1) and got[6][0] is None and got[7][0] == "GPL-3.0-only"


def test_complete_license_texts(spark):
    """Every licence that notices name has its complete text, but for those the README names."""
    files = {f.stem: f.read_text() for f in licenses.FILES.glob("*.txt")}
    absent = {"AGPL-3.0-only", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0"}
    assert {i for i, _ in licenses.NAMES} | {"BSL-1.0", "Unlicense", "Zlib"} == set(files) | absent | {"MIT", "ISC"}
    cases = [(i, f"Copyright (c) 2024 Somebody\n\n{t.upper()}") for i, t in files.items()]
    cases += [("BSD-3-Clause", "BSD 3-Clause License\n" + files["BSD-3-Clause"]), ("Apache-2.0", files["Apache-2.0"].split("   APPENDIX")[0])]
    cases += [("Unlicense", files["Unlicense"].replace("http:", "https:")), (None, files["BSD-2-Clause"].replace("source", "sauce"))]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(df, licenses.known_digests(spark)).collect()}
    assert [(got[i], w) for i, (w, _) in enumerate(cases) if got[i] != w] == []


def test_license_texts_in_any_wrapping(spark):
    files = {f.stem: f.read_text() for f in licenses.FILES.glob("*.txt")}
    short = [("MIT", licenses.TEXTS[0][1]), *((i, files[i]) for i in ("BSD-3-Clause", "BSL-1.0", "Unlicense", "Zlib"))]

    def wrapped(text, width):
        return "\n\n".join(textwrap.fill(p, width, break_on_hyphens=False) for p in text.split("\n\n"))

    cases = [(i, wrapped(t, w)) for i, t in short for w in range(50, 121)]
    cases += [(i, wrapped(files[i], w)) for i in ("Apache-2.0", "MPL-2.0") for w in (60, 75, 92, 10_000)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(df, licenses.known_digests(spark)).collect()}
    assert [(w, t[:80], got[i]) for i, (w, t) in enumerate(cases) if got[i] != w] == []


def test_license_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "MIT License"), (1, "Released under the MIT License"), (1, "Released under the MIT License"), (None, None)], "doc_id long, text string")
    got = licenses.scan(df, licenses.known_digests(spark)).collect()
    assert len(got) == 4 and sum(r["license_lines"] for r in got) == 2
    assert licenses.scan(df.limit(0), licenses.known_digests(spark)).count() == 0


def test_shards_balance_and_growth(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("é").alias("text"), F.lit(1).alias("shard"))
    rows = sharding.shard_rows(docs).collect()
    sizes = [sum(r["shard"] == s for r in rows) for s in range(8)]
    assert max(sizes) < 1.1 * min(sizes)
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert {r["grown_shard"] for r in moved} == {8} and 0.08 < len(moved) / len(rows) < 0.14
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    assert {r["size"] for r in rows} == {3}


def test_changed_weights_move_rows_into_the_grown_subtree_only(spark):
    t = sharding.tree(8)
    heavier = sharding.Node("root", (sharding.Node("r0", t.children[0].children), sharding.Node(
        "r1", tuple(sharding.Node(k.name, tuple(sharding.Node(s.name, shard=s.shard, weight=2.0) for s in k.children)) for k in t.children[1].children))))
    key = F.col("id").cast("string")
    got = spark.range(5000).select(sharding.shard_of(key, t).alias("a"), sharding.shard_of(key, heavier).alias("b")).where("a <> b").collect()
    assert got and all(r["b"] >= 4 for r in got) and all(r["a"] < 4 for r in got)


def test_shard_edge_cases(spark):
    df = spark.createDataFrame([(None, None), (1, "a"), (1, "a"), (1, "b")], "doc_id long, text string")
    rows = sharding.shard_rows(df).collect()
    assert len(rows) == 4 and len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    assert next(r for r in rows if r["doc_id"] is None)["size"] == 1
    assert sharding.shard_rows(df.limit(0)).count() == 0


@pytest.mark.parametrize("weights", [
    {"hot": 0.13958, **{f"s{i:02}": 0.86042 / 19 for i in range(19)}}, {"a": 0.9999, "b": 0.0001}, {"a": 2**0.5, "b": 3**0.5, "c": 1.0}])
def test_mixing_stays_within_a_block_of_exact_weights(weights):
    total = sum(map(Fraction, weights.values()))
    w = {s: Fraction(x) / total for s, x in weights.items()}
    ends = {s: int(x * 40_000) for s, x in w.items()}
    ends[max(ends, key=ends.get)] //= 2  # one ends early
    plan = mixing.schedule(weights, ends)
    assert {s: len(r[0]) for s, r in plan.items()} == {s: n for s, n in ends.items() if n}
    taken = [t for r in plan.values() for t in r[0]]
    assert len(taken) == len(set(taken))
    for s, runs in plan.items():
        for j, (t, release, deadline) in enumerate(zip(*runs)):
            assert (release, deadline) == (math.floor(j / w[s]), math.ceil((j + 1) / w[s])) and release <= t < deadline
            assert abs(j - t * w[s]) < 1 and abs(j + 1 - (t + 1) * w[s]) < 1


def test_mixed_rows_follow_the_exact_weights(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 60 == 0, "b").otherwise("a").alias("source"))
    w = spark.createDataFrame([("a", 0.9999), ("b", 0.0001)], "source string, weight double")
    rows = mixing.mix(docs, w, block_rows=1).collect()
    assert len(rows) == 6000 and len({r["slot"] for r in rows}) == 6000
    share = {"a": Fraction(0.9999), "b": Fraction(0.0001)}
    for r in rows:
        x = share[r["source"]] / sum(share.values())
        assert (r["release"], r["deadline"]) == (math.floor(r["block"] / x), math.ceil((r["block"] + 1) / x))
        assert r["release"] <= r["slot"] < r["deadline"]


def test_more_sources_than_any_limit_and_small_bins(spark):
    docs = spark.range(6000).select((F.col("id") % 50).alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3000).alias("source"), F.col("id").cast("string").alias("text"))
    rows = mixing.mix(docs, block_rows=1, bin_rows=1, bins=1).collect()
    assert len(rows) == 6000 and len({(r["slot"], r["seq"]) for r in rows}) == 6000
    assert sorted(r["slot"] for r in rows if r["block"] == 0) == list(range(3000))


def test_more_licences_than_are_broadcast(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["MIT License", "Released under the MIT License", licenses.TEXTS[0][1], "", None, "x\ny"])], "doc_id long, text string")
    known = licenses.known_digests(spark)
    assert sorted(map(tuple, licenses.scan(df, known, broadcast_known=3).collect()), key=str) == sorted(map(tuple, licenses.scan(df, known).collect()), key=str)


def test_mixing_keeps_all_rows(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else None, i) for i in range(500)] + [(7, "a", 0)], "doc_id long, source string, slot long")
    rows = mixing.mix(docs, block_rows=8).collect()
    assert len(rows) == 501 and len({(r["slot"], r["seq"]) for r in rows}) == 501
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(Exception, match="no weight"):
        mixing.mix(docs, spark.createDataFrame([("a", 1.0)], "source string, weight double")).collect()


def test_query_digests_are_of_the_planted_conversation(spark):
    from conftest import DATA

    row = chat_format.op5_chat_format(spark, DATA).where("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and row["loss_chars"] == len(text) and row["n_turns"] == 2
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
