"""Rules of ALTO and PAGE files that matter to their readers: what an element must have, hold and stand in.

Not a full schema: names of elements with their place, required attributes, required children, and the kind of attribute values. What is found is
said as rows (source_file, byte, rule, detail), none for a valid file."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .xmltree import El, ParseError, as_utf8, parse, sniff

SCHEMA = "source_file string, byte long, rule string, detail string"
#: element -> attributes it must have, where it may stand, children it must have.
RULES = {
    "alto": {
        "Layout": ((), ("alto",), ()), "Page": (("ID",), ("Layout",), ()),
        "PrintSpace": ((), ("Page",), ()), "TextBlock": (("ID",), ("PrintSpace", "ComposedBlock", "TopMargin", "BottomMargin", "LeftMargin", "RightMargin"), ()),
        "TextLine": ((), ("TextBlock",), ()), "String": (("CONTENT",), ("TextLine",), ()), "SP": ((), ("TextLine",), ()), "HYP": (("CONTENT",), ("TextLine",), ()),
    },
    "page": {
        "Page": (("imageFilename", "imageWidth", "imageHeight"), ("PcGts",), ()), "TextRegion": (("id",), ("Page", "TextRegion"), ("Coords",)),
        "TextLine": (("id",), ("TextRegion",), ("Coords",)), "Word": (("id",), ("TextLine",), ("Coords",)), "Coords": (("points",), (), ()),
        "TextEquiv": ((), ("TextRegion", "TextLine", "Word", "Glyph"), ("Unicode",)), "Metadata": ((), ("PcGts",), ("Creator", "Created", "LastChange")),
    },
}
_NUMBER = re.compile(r"[+-]?\d+(\.\d+)?")
_POINTS = re.compile(r"([0-9]+,[0-9]+ )+([0-9]+,[0-9]+)")
#: attribute -> what its value must look like.
VALUES = {
    **{a: lambda v: bool(_NUMBER.fullmatch(v)) for a in ("HPOS", "VPOS", "WIDTH", "HEIGHT", "imageWidth", "imageHeight")},
    **{a: lambda v: bool(_NUMBER.fullmatch(v)) and 0 <= float(v) <= 1 for a in ("WC", "conf")},
    "SUBS_TYPE": lambda v: v in ("HypPart1", "HypPart2", "Abbreviation"), "points": lambda v: bool(_POINTS.fullmatch(v.strip())),
}


def violations(raw: bytes) -> list[tuple[int, str, str]]:
    """(byte, rule, detail) of a file; a file that is no page XML is one violation."""
    raw, _ = as_utf8(raw)
    try:
        root = parse(raw)
        rules = RULES[sniff(root, root.ns)]
    except ParseError as e:
        return [(0, "unreadable", str(e))]
    out: list[tuple[int, str, str]] = []
    seen: set[str] = set()

    def tell(e: El, rule: str, detail: str) -> None:
        out.append((e.start, rule, f"{e.tag}: {detail}"))

    for e in root.iter():
        need, places, children = rules.get(e.tag, ((), (), ()))
        for a in need:
            if a not in e.attrs:
                tell(e, "missing_attribute", a)
        if places and (e.parent is None or e.parent.tag not in places):
            tell(e, "wrong_place", e.parent.tag if e.parent else "no parent")
        for c in children:
            if e.find(c) is None:
                tell(e, "missing_child", c)
        for a, v in e.attrs.items():
            if a in VALUES and not VALUES[a](v):
                tell(e, "bad_value", f"{a}={v}")
        own = e.attrs.get("ID") or e.attrs.get("id")
        if own is not None:
            if own in seen:
                tell(e, "repeated_id", own)
            seen.add(own)
    return out


def validate_files(files: DataFrame) -> DataFrame:
    """The violations of files given as (path, content), one row each."""

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 32):
                batch = whole.slice(a, 32)
                rows = [(path, *v) for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()) for v in violations(raw)]
                columns = list(zip(*rows)) or [[], [], [], []]
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["source_file", "byte", "rule", "detail"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)
