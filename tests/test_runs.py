"""Whole runs with models, routing, claims and images; what files say afterwards; what is refused."""

import struct
import sys
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import planning, producing, rules, seeing
from lectern.operators.policies import Capabilities, ConfigurationError, LossPolicy, PlanPolicy, RetryPolicy, RoutingPolicy, require_capabilities
from lectern.plans import correction, report
from lectern.sources import images, ocr_xml, rewrite, validate
from lectern.streaming import arrivals

cloudpickle.register_pickle_by_value(sys.modules[__name__])
LINE = "doc_id string, page_id string, line_id string, ord int, text string"
QUIET = RetryPolicy(transient_wait=0, output_wait=0)


class Echo:
    """Answers with ſ undone; writes down in the answer's usage what it was asked."""

    def complete(self, payload, temperature):
        lines = [{"line_id": x["line_id"], "corrected_text": x["ocr_text"].replace("ſ", "s")} for x in payload["lines"]]
        return {"lines": lines, "usage": {"input_tokens": len(lines), "output_tokens": 1}, "id": "r1"}


class Loud(Echo):
    def complete(self, payload, temperature):
        return {"lines": [{"line_id": x["line_id"], "corrected_text": x["ocr_text"] + "!"} for x in payload["lines"]]}


class Sure(Echo):
    def complete(self, payload, temperature):
        out = super().complete(payload, temperature)
        for x, y in zip(out["lines"], payload["lines"]):
            x |= {"status": "certain", "edits": [{"source": "veſte", "corrected": "veste", "reason": "confusion_connue"}] if "veſte" in y["ocr_text"] else []}
        return out


class Plain:
    def complete(self, payload, temperature):
        return {"lines": [x["ocr_text"].replace("ſ", "s") for x in payload["lines"]]}


class Broken:
    def complete(self, payload, temperature):
        raise producing.TransientError("busy")


def two_documents(spark):
    rows = [(d, "P", f"L{i}", i, t) for d in ("a", "b") for i, t in enumerate([f"la veſte {d}", "autre ligne ici", "fin"])]
    return spark.createDataFrame(rows, LINE)


def test_documents_may_share_ids(spark, tmp_path):
    got = correction.correct(two_documents(spark), client=Echo, store=str(tmp_path / "s"))
    rows = {(r["doc_id"], r["line_id"]): (r["status"], r["final_text"]) for r in got.decisions.collect()}
    assert rows["a", "L0"] == ("corrected", "la veste a") and rows["b", "L0"] == ("corrected", "la veste b") and len(rows) == 6
    said = got.report
    assert said["usage"] == {"calls": 2, "input_tokens": 6, "output_tokens": 2, "total_tokens": 8} and said["status"] == {"corrected": 6}
    kinds = {r["type"]: r["n"] for r in got.events.groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"document_parsed": 2, "page_started": 2, "page_completed": 2, "chunk_planned": 2, "chunk_started": 2, "chunk_completed": 2}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):  # an earlier run's answers are not overwritten
        correction.correct(two_documents(spark), client=Echo, store=str(tmp_path / "s"))


def test_skipped_lines_cost_no_call_and_escalated_ones_go_elsewhere(spark):
    rows = [("d", "P", "a", 0, "clean words only"), ("d", "P", "b", 1, "w0rd w1th d1gits"), ("d", "Q", "c", 2, "nothing odd here")]
    lines = spark.createDataFrame(rows, LINE)
    policies = correction.Policies(routing=RoutingPolicy(low=0.0, high=0.9), retry=QUIET)
    got = correction.correct(lines, client=Echo, escalate=Loud, policies=policies)
    assert {r["line_id"]: (r["tier"], r["final_text"]) for r in got.decisions.collect()} == {
        "a": ("skip", "clean words only"), "b": ("escalate", "w0rd w1th d1gits!"), "c": ("skip", "nothing odd here")}
    assert got.answers.count() == 1 and got.answers.agg(F.sum("calls")).first()[0] == 1
    assert got.outcomes.where("proposal is null").count() == 2


def test_claims_and_plain_answers(spark):
    got = correction.correct(two_documents(spark), client=Sure, claims=True, policies=correction.Policies(retry=QUIET))
    assert {r["producer_confidence"] for r in got.decisions.where("line_id = 'L0'").collect()} == {0.95}
    assert {r["producer_confidence"] for r in got.decisions.where("line_id = 'L1'").collect()} == {0.75}
    got = correction.correct(two_documents(spark), client=Plain, by_page=True, policies=correction.Policies(retry=QUIET))
    assert {r["final_text"] for r in got.decisions.where("line_id = 'L0'").collect()} == {"la veste a", "la veste b"}
    with pytest.raises(ConfigurationError):
        correction.correct(two_documents(spark), client=Plain, by_page=True, claims=True)


def test_failures_are_rows_with_a_reason(spark):
    got = correction.correct(two_documents(spark), client=Broken, policies=correction.Policies(retry=RetryPolicy(purse=2, attempts=1, transient_wait=0)))
    rows = got.decisions.collect()
    assert {r["status"] for r in rows} == {"fallback"} and all(r["final_text"] == r["text"] for r in rows)
    assert got.report["reasons"] == {"all_attempts_exhausted": 6}
    got = correction.correct(two_documents(spark), client=Echo, policies=correction.Policies(retry=RetryPolicy(deadline=-1.0)))
    assert got.report["reasons"] == {"aborted": 6} and got.report["usage"]["calls"] == 0


def chunk(*texts, blocks=None):
    return [{"line_id": f"l{i}", "text": t, "role": "NONE", "block_id": (blocks or [0] * len(texts))[i]} for i, t in enumerate(texts)]


def test_descent_goes_by_blocks_windows_and_lines():
    lines = chunk(*"abcdef", blocks=[0, 0, 1, 1, 2, 2])
    lines[3]["next_line"], lines[4]["prev_line"] = "l4", "l3"  # a unit joins the last two blocks
    wanted = {x["line_id"] for x in lines}
    name, parts = producing.finer(lines, wanted, "page")
    assert name == "block" and [sorted(p[1]) for p in parts] == [["l0", "l1"], ["l2", "l3", "l4", "l5"]]
    name, parts = producing.finer(lines, wanted, "block", PlanPolicy(window=3, overlap=1))
    assert name == "window" and sorted(i for p in parts for i in p[1]) == sorted(wanted)
    name, parts = producing.finer(lines, wanted, "window")
    assert name == "line" and [sorted(p[1]) for p in parts] == [["l0"], ["l1"], ["l2"], ["l3", "l4"], ["l5"]]
    assert producing.finer(lines[:1], {"l0"}, "line") is None


def test_waits_grow_with_the_attempt_and_pairs_are_asked_again_at_once():
    waits, seen = [], []

    class Moody:
        def __init__(self):
            self.answers = [producing.TransientError("busy"), {"lines": []}, {"lines": [{"line_id": "l0", "corrected_text": "x"}]}]

        def complete(self, payload, temperature):
            seen.append(temperature)
            a = self.answers.pop(0)
            if isinstance(a, Exception):
                raise a
            return a

    out = producing.attempt(Moody(), chunk("x"), {"l0"}, RetryPolicy(), sleep=waits.append)
    assert out["l0"]["proposal"] == "x" and waits == [2.0, 2.0] and seen == [0.0, 0.3, 0.5]
    assert [RetryPolicy.deterministic().temperature_for(k) for k in (1, 2, 9)] == [0.0] * 3 and [RetryPolicy().temperature_for(k) for k in (0, 2, 9)] == [0.0, 0.3, 0.5]


def test_pages_are_planned_by_blocks_where_these_fit(spark):
    rows = [("d", "P", f"l{i}", i, "x" * 10, i // 3, "l2" if i in (2, 3) else None) for i in range(9)]
    lines = spark.createDataFrame(rows, LINE + ", block_id int, unit_id string")
    got = correction.plan(lines, PlanPolicy(max_chars=70)).orderBy("chunk_ix").collect()
    assert [(r["granularity"], r["target_ids"]) for r in got] == [("block", [f"l{i}" for i in range(6)]), ("block", ["l6", "l7", "l8"])]
    assert {r["granularity"] for r in correction.plan(lines, PlanPolicy(max_chars=50)).collect()} == {"window"}


def test_images_per_call():
    units = {"b": "b", "c": "b"}
    assert planning.image_batches(list("abcd"), set("abcd"), units, 2) == [["a"], ["b", "c"], ["d"]]
    assert planning.image_batches(list("abcd"), {"d"}, units, 2) == [["d"]]
    with pytest.raises(ConfigurationError):
        planning.image_batches(list("abc"), set("abc"), units, 1)


def test_capabilities_explain_themselves():
    c = Capabilities(max_images=2)
    assert c.reason_cannot_serve(needs_image=True) == "model has no vision capability" and c.can_serve()
    assert c.reason_cannot_serve(images=3) == "needs 3 images but model caps at 2" and not Capabilities(structured_output=False).can_serve(needs_structured_output=True)
    with pytest.raises(ConfigurationError):
        require_capabilities(c, needs_image=True)
    require_capabilities(None, needs_image=True)


HEAD = '<?xml version="1.0" encoding="UTF-8"?><alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout><Page ID="P" WIDTH="900" HEIGHT="900"><PrintSpace><TextBlock ID="B">'
TAIL = "</TextBlock></PrintSpace></Page></Layout></alto>"


def halves(first, second, word, more=""):
    return (HEAD + f'<TextLine ID="a"><String CONTENT="vers"/><SP/><String CONTENT="{first}" SUBS_TYPE="HypPart1" SUBS_CONTENT="{word}"/><HYP CONTENT="-"/></TextLine>'
            f'<TextLine ID="b"><String CONTENT="{second}" SUBS_TYPE="HypPart2" SUBS_CONTENT="{word}"/><SP/><String CONTENT="bleue"/>{more}</TextLine>' + TAIL).encode()  # fmt: skip


def run_file(spark, tmp_path, raw, rule, **options):
    (tmp_path / "f.xml").write_bytes(raw)
    done = correction.correct_files(spark, str(tmp_path / "f.xml"), rule_list=[rule], **options)
    row = done.files.first()
    return done, row["content"].decode(), {x["line_id"]: x["path"] for x in row["lines"]}


def test_marks_follow_the_pair(spark, tmp_path):
    _, text, paths = run_file(spark, tmp_path, halves("mai", "son", "maison"), rules.Rule("v", "w"))
    assert text.count('SUBS_CONTENT="maison"') == 2 and paths == {"a": "fast", "b": "untouched"}
    done, text, paths = run_file(spark, tmp_path, halves("mai", "son", "maison"), rules.Rule("a", "o"))
    assert "SUBS" not in text and done.report["reasons"] == {"hyphen_pair_fallback": 2} and paths == {"a": "subs_only", "b": "subs_only"}
    _, text, paths = run_file(spark, tmp_path, halves("mai", "son", "autre"), rules.Rule("z", "s"))
    assert "SUBS" not in text and paths == {"a": "subs_only", "b": "subs_only"}
    _, text, paths = run_file(spark, tmp_path, halves("mai", "son", "maison"), rules.Rule("(bleue)", r"\1 ", regex=True))
    assert paths["b"] == "untouched" and text.count('SUBS_CONTENT="maison"') == 2


def test_rebuilt_lines_keep_their_marks():
    raw = halves("mai", "son", "maison")
    done, rows = rewrite.rewrite(raw, {("P", "b"): ("son bleue et grande", "PART2", "maison", None)})
    assert {r["line_id"]: r["path"] for r in rows} == {"a": "untouched", "b": "slow"}
    assert done.decode().count('SUBS_TYPE="HypPart2" SUBS_CONTENT="maison"') == 1 and not any(r["losses"] for r in rows)


def test_changed_and_unreadable_files_are_withheld(spark, tmp_path):
    good = halves("mai", "son", "maison")
    (tmp_path / "f.xml").write_bytes(good)
    files = ocr_xml.read_files(spark, str(tmp_path / "f.xml"))
    parsed = ocr_xml.lines_of(files).withColumn("doc_id", F.lit("d")).cache()
    correction.preflight(files, parsed)
    stale = parsed.withColumn("digest", F.lit("sha256:0"))
    with pytest.raises(ConfigurationError):
        correction.preflight(files, stale)
    row = correction.rewritten(files, stale.drop("error")).files.first()
    assert not row["delivered"] and "changed" in row["error"] and row["content"] == good


def test_a_bad_file_does_not_stop_the_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "good.xml").write_bytes(halves("mai", "son", "maison"))
    (folder / "bad.xml").write_bytes(b"<alto><Layout>")
    out = str(tmp_path / "out")
    arrivals.correct_arrivals(spark, str(folder), out, str(tmp_path / "state")).awaitTermination()
    got = {r["source_file"][-8:]: (r["delivered"], r["error"] is None) for r in spark.read.parquet(out).collect()}
    assert got == {"good.xml": (True, True), "/bad.xml": (False, False)}


def test_words_that_cannot_be_aligned_go_to_the_sidecar(spark):
    rows = [("d", "P", "a", 0, "one two three four", 4), ("d", "P", "b", 1, "alpha beta gamma", 3)]
    lines = correction.prepare(spark.createDataFrame(rows, LINE + ", word_count int"))
    new = F.when(F.col("line_id") == "a", F.lit("four one two three x")).otherwise(F.lit("alpha beta gamma delta"))
    got = correction.judge(lines.withColumn("corrected", new), correction.Policies(loss=LossPolicy(least_alignment=0.6)))
    assert {r["line_id"]: r["status"] for r in got.collect()} == {"a": "fallback", "b": "corrected"}
    side = report.sidecar(got).collect()
    assert [(r["line_id"], r["corrected_text"], r["reason"].split(":")[0]) for r in side] == [("a", "four one two three x", "token_realign")]
    got = correction.judge(lines.withColumn("corrected", new), correction.Policies(loss=LossPolicy(strict=True)))
    assert {r["line_id"]: (r["fallback_reason"] or "").split(":")[0] for r in got.collect()} == {"a": "format_loss", "b": "format_loss"}


def test_chains_longer_than_a_request_are_cut(spark):
    rows = [("d", "P", f"l{i}", i, "mot-" if i < 4 else "fin") for i in range(5)]
    got = correction.correct(spark.createDataFrame(rows, LINE), policies=correction.Policies(plan=PlanPolicy(max_lines=2, window=2, overlap=1)))
    assert [(r["line_id"], r["role"], r["next_line"]) for r in got.decisions.orderBy("ord").collect()] == [
        ("l0", "PART1", "P::l1"), ("l1", "PART2", None), ("l2", "PART1", "P::l3"), ("l3", "PART2", None), ("l4", "NONE", None)]
    assert got.report["hyphen_splits"] == 2 and got.report["unpaired_breaks"] is None


def test_quality_with_a_lexicon(spark):
    score = lambda x: spark.range(1).select(T.quality_score(F.lit(x), {"la", "Maison"})).first()[0]
    assert [score(x) for x in ("la maison,", "la maisqn", "12 la", "l4 la", "...")] == [0.0, 0.5, 0.0, 0.5, 0.0]


def test_folders_are_documents(spark, tmp_path):
    for d in "xy":
        (tmp_path / d).mkdir()
        (tmp_path / d / "1.xml").write_bytes((HEAD + '<TextLine ID="a"><String CONTENT="une mai-"/></TextLine>' + TAIL).encode())
        (tmp_path / d / "2.xml").write_bytes((HEAD + '<TextLine ID="a"><String CONTENT="son veſte"/></TextLine>' + TAIL).encode())
    done = correction.correct_files(spark, str(tmp_path / "*" / "*.xml"))
    rows = done.decisions.collect()
    assert len({r["doc_id"] for r in rows}) == 2 and sorted(r["role"] for r in rows) == ["PART1", "PART1", "PART2", "PART2"]
    assert all(r["page_id"].endswith("::P") for r in rows) and done.report["withheld"] == 0
    alone = correction.correct_files(spark, str(tmp_path / "*" / "*.xml"), document=lambda path: path).decisions.collect()
    assert sorted(r["role"] for r in alone) == ["NONE", "NONE", "PART1", "PART1"]


def test_provenance_names_what_was_used(spark):
    got = correction.correct(two_documents(spark), producer=report.Producer("rules", "7", None, "f"))
    p = got.report["provenance"]
    assert p["producer"]["name"] == "rules" and p["config_fingerprint"] == correction.Policies().fingerprint() and p["dependencies"]["pyspark"]


@pytest.mark.parametrize("message, masked", [
    ('{"api_key": "abc123", "n": 1}', '{"api_key": "****", "n": 1}'), ('{"token":"t0p"}', '{"token":"****"}'), ("password=hunter2&x=1", "password=****&x=1"),
    ("Authorization: Bearer abc.def", "Authorization: Bearer ****"), ("basic dXNlcjpwYXNz!", "basic ****"), ("key sk-ABCD12345 used", "key sk-ABCD**** used"),
    ("X-Auth-Token: q,r end", "X-Auth-Token: **** end"), ("nothing here", "nothing here")])
def test_secrets(spark, message, masked):
    assert spark.range(1).select(T.sanitize_error(F.lit(message))).first()[0] == masked


def test_validation():
    good = halves("mai", "son", "maison").replace(b"<TextLine", b'<TextLine HPOS="1"')
    assert validate.violations(good) == []
    bad = good.replace(b'CONTENT="vers"', b"").replace(b'HPOS="1"', b'HPOS="far"', 1).replace(b'ID="b"', b'ID="a"')
    assert {(r, d) for _, r, d in validate.violations(bad)} == {("missing_attribute", "String: CONTENT"), ("bad_value", "TextLine: HPOS=far"), ("repeated_id", "TextLine: a")}
    assert validate.violations(b"<a/>")[0][1] == "unreadable"
    assert {r for _, r, _ in validate.violations(b'<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page><Word id="w"/></Page></PcGts>')} == {
        "missing_attribute", "missing_child", "wrong_place"}


def filtered_png(pixels, kind):
    """A PNG whose rows all use one filter."""
    h, w, c = pixels.shape
    wide = np.zeros((h + 1, w + 1, c), int)
    wide[1:, 1:] = pixels
    left, up, corner = wide[1:, :-1], wide[:-1, 1:], wide[:-1, :-1]
    p = left + up - corner
    a, b, cc = abs(p - left), abs(p - up), abs(p - corner)
    guess = [0 * left, left, up, (left + up) // 2, np.where((a <= b) & (a <= cc), left, np.where(b <= cc, up, corner))][kind]
    rows = np.concatenate([np.full((h, 1), kind, np.uint8), ((pixels - guess) & 255).astype(np.uint8).reshape(h, -1)], 1).tobytes()
    out = images.write_png(pixels)
    body = zlib.compress(rows)
    start = out.index(b"IDAT") - 4
    end = out.index(b"IEND") - 4
    return out[:start] + struct.pack(">I", len(body)) + b"IDAT" + body + struct.pack(">I", zlib.crc32(b"IDAT" + body)) + out[end:]


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png_filters(kind, channels):
    pixels = np.random.default_rng(kind).integers(0, 256, (7, 9, channels), dtype=np.uint8)
    assert (images.read_png(filtered_png(pixels, kind)) == pixels).all() and images.size(images.write_png(pixels)) == ("image/png", 9, 7)


def test_image_headers_and_crops():
    exif = b"Exif\0\0MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0\x06\0\0\0\0\0\0"
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 30, 40, 1)
    assert images.orientation(jpeg) == 6 and images.size(jpeg) == ("image/jpeg", 30, 40)
    assert images.asset("p", jpeg, 60, 80).scale_x == 0.5
    pixels = np.arange(100, dtype=np.uint8).reshape(10, 10, 1)
    c = images.crop("l", pixels, (2, 1, 6, 4), [(2, 1), (6, 1), (2, 4)])
    back = images.read_png(c.content)
    assert (c.width, c.height) == (4, 3) and back[0, 0, 0] == 12 and back[2, 3, 0] == 255
    with pytest.raises(Exception, match="neither"):
        images.size(b"GIF")


class Seer:
    """Answers with the size of every crop it was shown."""

    def complete_multimodal(self, payload, shown, temperature):
        seen = {i: images.size(content)[1:] for i, _, content in shown}
        assert len(shown) <= 2
        return {"lines": [{"line_id": x["line_id"], "corrected_text": f"{x['ocr_text']} {seen[x['line_id']]}"} for x in payload["lines"]], "usage": {"input_tokens": 1}}


def test_a_producer_that_sees(spark):
    line = "struct<ord:int,line_id:string,text:string,hpos:int,vpos:int,width:int,height:int,polygon:string,unit_id:string,prev_line:string,next_line:string,role:string>"
    lines = [(i, f"l{i}", "t", 0, 20 * i, 50, 10, None, None, None, None, "NONE") for i in range(3)]
    chunks = spark.createDataFrame([("d", p, 0, "page", lines, ["l0", "l1", "l2"]) for p in ("P", "Q", "R")],
                                   f"doc_id string, page_id string, chunk_ix int, granularity string, lines array<{line}>, target_ids array<string>")
    png = images.write_png(np.zeros((200, 100, 3), np.uint8))
    pages = spark.createDataFrame([("d", "P", png, 100, 100), ("d", "Q", png, 100, 100)], "doc_id string, page_id string, content binary, page_width int, page_height int")
    pages = pages.withColumn("digest", F.when(F.col("page_id") == "P", T.source_digest(F.col("content"))).otherwise("sha256:0"))
    got = seeing.produce_seeing(chunks, pages, Seer, Capabilities(vision=True, max_images=2), QUIET, margin=0.0).collect()
    by = {(r["page_id"], r["line_id"]): (r["proposal"], r["reason"]) for r in got}
    assert by["P", "l1"] == ("t (50, 20)", None) and by["Q", "l0"] == (None, "image_changed") and by["R", "l2"] == (None, "image_missing") and len(by) == 9
    with pytest.raises(ConfigurationError):
        seeing.produce_seeing(chunks, pages, Seer, Capabilities())
