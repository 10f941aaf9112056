"""What grows with the tables: no step may do more than its input asks for."""

import difflib
import random

import pytest
from conftest import DATA

from lectern.functions import ratio as ratios
from lectern.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ratio_needs_no_automaton_for_parts_and_strangers(monkeypatch):
    def refuse(*_):
        raise AssertionError("an automaton was built")

    with monkeypatch.context() as m:
        m.setattr(ratios, "_automaton", refuse)
        a, b = "ab" * 400, "cd" * 400
        assert ratios.ratio(a, f"{a} {b}") == 2 * 800 / 2401 and ratios.ratio(f"{a}~", a + b) == 2 * 800 / 2401 and ratios.ratio(a, b) == 0
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab ") for _ in range(rng.randrange(9))) for _ in range(2))
        want = difflib.SequenceMatcher(None, a, b, False).ratio()
        assert ratios.ratio(a, b) == pytest.approx(want) and ratios.bound(a, b) >= want - 1e-12


@pytest.mark.parametrize("name", ["chain_roles", "unit_splits", "unpaired_breaks", "hyphen_roles", "final_edit_script", "stage_a_drift", "stage_b_part1", "stage_b_part2", "stage_b_reconcile"])
def test_lines_and_pairs_take_one_shuffle(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_ops_are_judged_once(spark):
    text = plan(QUERIES["edit_rejections"](spark, DATA))
    assert text.count("Join") == 1


@pytest.mark.parametrize("name", ["char_similarity", "char_similarity_ascii"])
def test_lines_are_not_compared_character_by_character(spark, name):
    assert "levenshtein" not in plan(QUERIES[name](spark, DATA))


def test_a_plain_file_is_rewritten_without_a_tree_of_places(monkeypatch):
    from lectern.sources import rewrite, xmltree

    lines = "".join(f'<a:TextLine ID="L{i}" HPOS="0" WIDTH="90"><a:String CONTENT="x&gt;{i}" WC="0.5"/><a:SP/><a:String CONTENT="y"></a:String></a:TextLine>' for i in range(4))
    raw = f'<?xml version="1.0"?><a:alto xmlns:a="http://www.loc.gov/standards/alto/ns-v4#"><a:Description><a:x/></a:Description><a:Layout><a:Page ID="P"><a:TextBlock>{lines}</a:TextBlock></a:Page></a:Layout></a:alto>'
    decided = {("P", "L1"): ("x>1 z", None, None, None), ("P", "L2"): ("q x>2 y", None, None, None)}
    want = rewrite.rewrite(raw.replace("<a:Layout>", "<!-- c --><a:Layout>").encode(), decided, "n")  # a comment asks for the tree
    calls = []
    monkeypatch.setattr(rewrite, "parse", lambda raw: calls.append(1) or xmltree.parse(raw))
    got = rewrite.rewrite(raw.encode(), decided, "n")
    assert not calls and got[0] == want[0].replace(b"<!-- c -->", b"") and got[1] == want[1] and [r["extracted"] for r in got[1]] == ["x>0 y", "x>1 z", "q x>2 y", "x>3 y"]


def test_a_few_changed_words_need_no_table(monkeypatch):
    from lectern.operators import align

    def refuse(*_):
        raise AssertionError("a table was filled")

    monkeypatch.setattr(align, "_Band", refuse)
    words = [f"word{chr(97 + i % 26)}{i}" for i in range(60)]
    new = [w + "e" if i % 9 == 4 else w for i, w in enumerate(words)]
    found = align.align(words, new)
    assert [p[:2] for p in found.pairs] == [(i, i) for i in range(60)] and not found.move_suspected


def test_pages_are_aligned_without_a_frame_each(spark):
    assert "Pandas" not in plan(QUERIES["page_alignment"](spark, DATA))


def test_distances_together():
    from lectern.functions.distance import distance, distances

    rng = random.Random(7)
    text = lambda: "".join(rng.choice("abé𝔸") for _ in range(rng.choice((0, 1, 63, 64, 65, 128, 130))))
    pairs = [(text(), text() + rng.choice(("", "x"))) for _ in range(800)]
    assert distances(pairs) == [distance(a, b) for a, b in pairs]


def test_windows_are_planned_without_a_frame_a_page(spark):
    assert "Pandas" not in plan(QUERIES["chunk_windows"](spark, DATA))


@pytest.mark.parametrize("name", ["alto_rewrite", "stage_c_accept", "page_alignment", "char_similarity"])
def test_heavy_steps_are_not_merged_into_few_tasks(spark, name):
    assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, DATA))
