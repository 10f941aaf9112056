"""Words broken across lines: roles, pairs of lines, and the units they form.

A line's role is NONE, PART1 (it ends in a broken word), PART2 (it begins with the rest of one)
or BOTH. All of it is projections and windows over the lines of a document in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .policies import PairingPolicy


def heuristic_roles(lines: DataFrame, page: str = "page_id", order: str = "ord") -> DataFrame:
    """``role`` from marks only: PART1 after a letter and a mark, BOTH if the line before has one too."""
    w = Window.partitionBy(page).orderBy(order)
    mark = T.trailing_hyphen_char(F.col("text")).isNotNull()
    return (
        lines.withColumn("__mark", mark)
        .withColumn("role", F.when(F.col("__mark") & F.coalesce(F.lag("__mark").over(w), F.lit(False)), "BOTH")
                    .when(F.col("__mark"), "PART1").otherwise("NONE"))
        .drop("__mark")
    )


#: What markup says of the break a line begins with and of the one it ends with: declared at all, and the whole word.
MARKUP = ("begin_explicit", "begin_subs", "end_explicit", "end_subs")


def explicit_roles(lines: DataFrame) -> DataFrame:
    """Roles of lines with ALTO tokens (array of kind, subs_type, subs_content): markup first, marks else; and ``MARKUP``."""
    words = F.filter("tokens", lambda t: t["kind"] == "String")
    first, last = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(-1))
    hyp = F.coalesce(F.try_element_at(F.col("tokens"), F.lit(-1))["kind"] == "HYP", F.lit(False))
    back = F.coalesce(first["subs_type"] == "HypPart2", F.lit(False))
    marked = hyp | F.coalesce(last["subs_type"] == "HypPart1", F.lit(False))
    front = marked | T.trailing_hyphen_char(F.col("text")).isNotNull()
    return (
        lines.withColumn("role", F.when(back & front, "BOTH").when(front, "PART1").when(back, "PART2").otherwise("NONE"))
        .withColumn("begin_explicit", back)
        .withColumn("begin_subs", F.when(back, first["subs_content"]))
        .withColumn("end_explicit", front & marked)
        .withColumn("end_subs", F.when(marked & (last["subs_type"] == "HypPart1"), last["subs_content"]))
    )


def can_pair(a: Column, b: Column, policy: PairingPolicy = PairingPolicy()) -> Column:
    """Whether line b can hold the rest of line a's broken word.

    a and b are structs of page_id, block_id, hpos, vpos, width, height and explicit."""
    same_page, same_block = a["page_id"] == b["page_id"], a["block_id"] == b["block_id"]
    gap = (b["vpos"] - (a["vpos"] + a["height"])).cast("double")
    h = a["height"].cast("double")
    overlap = (a["hpos"] < b["hpos"] + b["width"]) & (b["hpos"] < a["hpos"] + a["width"])
    empty = (a["width"] <= 0) | (a["height"] <= 0) | (b["width"] <= 0) | (b["height"] <= 0)
    equal = (a["hpos"] == b["hpos"]) & (a["vpos"] == b["vpos"]) & (a["width"] == b["width"]) & (a["height"] == b["height"])
    below = gap >= -policy.max_rise * h
    near = gap <= policy.max_gap * h
    above = b["vpos"] + b["height"] <= a["vpos"]
    geometry = F.when(same_block, below & near).when(below, near & overlap).otherwise(~overlap & above)
    out = F.when(F.lit(not policy.geometric_checks) | ~same_page | a["explicit"] | b["explicit"] | empty | equal, True)
    out = out.otherwise(geometry)
    if policy.max_vertical_gap is not None:
        out = F.when(same_page & (gap > policy.max_vertical_gap), False).otherwise(out)
    return F.when(~same_block, False).otherwise(out) if policy.same_block_only else out


def link_lines(lines: DataFrame, doc: str = "doc_id", order: str = "ord", condition: Column | None = None) -> DataFrame:
    """``next_line`` (the line that continues this one's broken word) and ``prev_line``, and roles after linking.

    Every PART1 and BOTH line is joined to the next line with text, across pages of a document,
    if ``condition`` (on the structs ``here`` and ``next``, see ``can_pair``) holds. A continued NONE becomes
    PART2 and a continued PART1 becomes BOTH; where ``MARKUP`` is known, both halves of a pair get the whole word that either names, and a half
    that is not marked itself counts as marked if the first is. A line is read once: the document is one sorted stream, lines without
    text stand in a stream of their own, so the links are a ``lead`` and the whole costs one shuffle by document."""
    have = set(lines.columns)
    marked = {*MARKUP} <= have
    geometry = [c for c in ("page_id", "block_id", "hpos", "vpos", "width", "height") if c in have] if condition is not None else []
    shown = [F.col(c) for c in ("line_id", *geometry, *(["begin_subs"] if marked else []))]
    if condition is not None:
        shown.append(F.coalesce(F.col("begin_explicit") | F.col("end_explicit"), F.lit(False)).alias("explicit") if marked else F.lit(False).alias("explicit"))
    placed = lines.withColumn("__at", F.row_number().over(Window.partitionBy(doc).orderBy(order))).withColumn(
        "__filled", F.coalesce(T.py_strip(F.col("text")) != "", F.lit(False)))
    w = Window.partitionBy(doc, "__filled").orderBy("__at")
    led = placed.withColumn("here", F.struct(*shown)).withColumn("next", F.lead("here").over(w))
    ok = F.col("__filled") & F.col("role").isin("PART1", "BOTH") & F.col("next").isNotNull()
    ok = ok & (condition if condition is not None else F.lit(True))
    linked = led.withColumn("__ok", F.coalesce(ok, F.lit(False))).withColumn("next_line", F.when(F.col("__ok"), F.col("next.line_id")))
    was = lambda c: F.when(F.lag("__ok").over(w), F.lag(c).over(w))
    linked = linked.withColumn("prev_line", was("line_id"))
    if marked:
        linked = linked.withColumn("__end_subs", F.when(F.col("__ok"), F.coalesce("end_subs", F.col("next.begin_subs"))).otherwise(F.col("end_subs")))
        began = F.col("role").isin("PART2", "BOTH")
        linked = linked.withColumn("begin_explicit", F.coalesce(F.when(F.col("prev_line").isNotNull() & ~began, was("end_explicit")), "begin_explicit"))
        linked = linked.withColumn("begin_subs", F.coalesce(was("__end_subs"), "begin_subs")).withColumn("end_subs", F.col("__end_subs")).drop("__end_subs")
    continued = F.col("prev_line").isNotNull()
    return linked.withColumn("role", F.when(continued, F.when(F.col("role").isin("PART1", "BOTH"), "BOTH").otherwise("PART2")).otherwise(F.col("role"))).drop(
        "here", "next", "__ok", "__at", "__filled")


def unpaired_breaks(linked: DataFrame) -> DataFrame:
    """Lines whose role promises a partner that is not there."""
    return linked.where(
        (F.col("role").isin("PART1", "BOTH") & F.col("next_line").isNull())
        | (F.col("role").isin("PART2", "BOTH") & F.col("prev_line").isNull())
    )


def with_units(linked: DataFrame, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """All lines with ``unit_id`` (null outside units of two or more), ``member`` (from 0), ``size``, ``spans_pages``.

    Links go to the next filled line, so units are runs: gaps and islands, no graph search."""
    w = Window.partitionBy(doc).orderBy(order)
    inside = F.col("next_line").isNotNull() | F.col("prev_line").isNotNull()
    begins = inside & F.col("prev_line").isNull()
    rows = linked.withColumn("unit_id", F.when(inside, F.last(F.when(begins, F.col("line_id")), ignorenulls=True).over(w)))
    # a line outside units is a group of its own, so no window holds more than a unit
    u = Window.partitionBy(doc, F.coalesce("unit_id", "line_id"))
    return (
        rows.withColumn("member", F.when(inside, F.row_number().over(u.orderBy(order)) - 1))
        .withColumn("size", F.when(inside, F.count("*").over(u)))
        .withColumn("spans_pages", F.when(inside, F.min("page_id").over(u) != F.max("page_id").over(u)))
    )


def units(linked: DataFrame, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """Only the lines in units, see ``with_units``."""
    return with_units(linked, doc, order).where("unit_id is not null")


def split_units(members: DataFrame, cap: int) -> DataFrame:
    """``unit_id_final``: units longer than ``cap`` lines are cut after every cap-th."""
    part = F.floor(F.col("member") / cap)
    return members.withColumn("split", (F.col("member") > 0) & (F.col("member") % cap == 0)).withColumn(
        "unit_id_final", F.when(F.col("size") <= cap, F.col("unit_id").cast("string")).otherwise(
            F.concat_ws("#", F.col("unit_id").cast("string"), part.cast("string"))))


def sever(rows: DataFrame, cap: int) -> DataFrame:
    """Units longer than ``cap`` lines cut into parts that a request can hold; ``severed`` marks the last line before a cut.

    ``rows``: of ``with_units``. The cut halves become lines of their own: the link, the role's half and the whole word go, the texts stay. A part of
    one line is no unit."""
    part = F.floor(F.col("member") / cap)
    long_ = F.coalesce(F.col("size") > cap, F.lit(False))
    tail = long_ & (F.col("member") % cap == cap - 1) & (F.col("member") < F.col("size") - 1)
    head = long_ & (F.col("member") > 0) & (F.col("member") % cap == 0)
    alone = long_ & (F.col("member") == F.col("size") - 1) & head
    none = lambda c: F.lit(None).cast(dict(rows.dtypes)[c])
    role = F.when(tail & (F.col("role") == "BOTH"), "PART2").when(tail, "NONE").when(head & (F.col("role") == "BOTH"), "PART1").when(head, "NONE").otherwise(F.col("role"))
    role = F.when(tail & head, "NONE").otherwise(role)
    out = rows.withColumn("severed", tail).withColumn("role", role).withColumn("next_line", F.when(tail, none("next_line")).otherwise(F.col("next_line"))).withColumn(
        "prev_line", F.when(head, none("prev_line")).otherwise(F.col("prev_line")))
    if {*MARKUP} <= set(rows.columns):
        out = out.withColumn("end_subs", F.when(tail, none("end_subs")).otherwise(F.col("end_subs"))).withColumn(
            "begin_subs", F.when(head, none("begin_subs")).otherwise(F.col("begin_subs")))
    unit = F.when(alone, none("unit_id")).when(long_, F.concat_ws("#", F.col("unit_id").cast("string"), part.cast("string"))).otherwise(F.col("unit_id").cast("string"))
    return out.withColumn("unit_id", unit)


def pair_fields(lines: DataFrame, w) -> DataFrame:
    """Neighbours of every line: prev_text, next_text, prev_role, next_role."""
    return lines.select(
        "*", F.lag("text").over(w).alias("prev_text"), F.lead("text").over(w).alias("next_text"),
        F.lag("role").over(w).alias("prev_role"), F.lead("role").over(w).alias("next_role"),
    )


def close_over_units(flagged: DataFrame, flag: str = "revert", unit: str = "unit_id", doc: str = "doc_id") -> DataFrame:
    """A line is flagged if any member of its unit is; lines without a unit stay as they are."""
    w = Window.partitionBy(doc, F.coalesce(F.col(unit).cast("string"), F.col("line_id").cast("string")))
    return flagged.withColumn(flag, F.when(F.col(unit).isNull(), F.col(flag)).otherwise(F.max(flag).over(w)))
