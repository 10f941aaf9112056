"""A producer that is shown its lines: crops of the page image go along with each chunk.

A chunk is a page's lines with the page's image. Every target line is cut out by its box, grown by a margin and, if asked, masked by its polygon;
the model answers as the text producer does, so the same checks, retries and descent apply. A call holds no more images than the model takes."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import producing
from .planning import image_batches
from .policies import Capabilities, PlanPolicy, RetryPolicy, require_capabilities
from .vision import ImageError


class Shown:
    """A client for one page: adds the crops of the lines asked for, and splits a chunk that needs more images than a call holds."""

    def __init__(self, client: producing.MultimodalClient, crops: dict[str, tuple[str, bytes]], units: dict[str, str], cap: int | None):
        self.client, self.crops, self.units, self.cap = client, crops, units, cap

    def complete(self, payload: dict[str, Any], temperature: float) -> dict[str, Any]:
        ids = [x["line_id"] for x in payload["lines"]]
        calls = image_batches(ids, {*payload["targets"]}, self.units, self.cap) if self.cap is not None else [ids]
        lines: list = []
        usage = {"input_tokens": 0, "output_tokens": 0}
        for own in calls:
            part = payload | {"lines": [x for x in payload["lines"] if x["line_id"] in own], "targets": [i for i in payload["targets"] if i in own]}
            images = [(i, *self.crops[i]) for i in own if i in self.crops]
            answer = self.client.complete_multimodal(part, images, temperature)
            if not isinstance(answer, dict) or not isinstance(answer.get("lines"), list):
                raise producing.Violation("no_lines")
            lines += answer["lines"]
            for k in usage:
                usage[k] += answer.get("usage", {}).get(k, 0)
        return {"lines": lines, "usage": usage}


def line_crops(lines: list[dict], content: bytes, page_width: int, page_height: int, margin: float, mask: bool) -> dict[str, tuple[str, bytes]]:
    """line_id -> (media type, bytes) of every line that has a box on the page."""
    from ..sources import images

    pixels = images.read_png(content)
    sx = pixels.shape[1] / page_width if page_width > 0 else 1.0
    sy = pixels.shape[0] / page_height if page_height > 0 else 1.0
    out = {}
    for x in lines:
        if not x.get("width") or not x.get("height"):
            continue
        dx, dy = x["width"] * sx * margin, x["height"] * sy * margin
        left, top = max(0, round(x["hpos"] * sx - dx)), max(0, round(x["vpos"] * sy - dy))
        right = min(pixels.shape[1], max(left + 1, round((x["hpos"] + x["width"]) * sx + dx)))
        bottom = min(pixels.shape[0], max(top + 1, round((x["vpos"] + x["height"]) * sy + dy)))
        points = [tuple(float(v) for v in p.split(",")) for p in (x.get("polygon") or "").split() if p.count(",") == 1] if mask else []
        try:
            piece = images.crop(x["line_id"], pixels, (left, top, right, bottom), [(a * sx, b * sy) for a, b in points] or None)
        except ImageError:
            continue
        out[x["line_id"]] = (piece.media_type, piece.content)
    return out


def produce_seeing(
    chunks: DataFrame, images: DataFrame, client: Callable[[], producing.MultimodalClient], capabilities: Capabilities = Capabilities(vision=True),
    policy: RetryPolicy = RetryPolicy(), margin: float = 0.1, mask: bool = False, claims: bool = False, plan: PlanPolicy = PlanPolicy(),
) -> DataFrame:
    """Proposals as ``producing.produce`` gives them, for chunks whose lines hold hpos, vpos, width, height (and polygon, unit_id).

    ``images``: doc_id, page_id, content, digest, page_width, page_height. Pages whose image is missing or has changed since its digest was taken get no call; their
    lines say so. An image goes to the tasks of its page only."""
    require_capabilities(capabilities, needs_image=True, needs_structured_output=True)
    sound = images.withColumn("sound", F.col("digest") == T.source_digest(F.col("content")))
    joined = chunks.join(sound.select("doc_id", "page_id", "content", "sound", "page_width", "page_height"), ["doc_id", "page_id"], "left")

    def run(batches):
        made = client()
        for batch in batches:
            rows = []
            for c in batch.to_dict("records"):
                lines = [dict(x) if isinstance(x, dict) else x.asDict() for x in c["lines"]]
                key = {"doc_id": str(c["doc_id"]), "page_id": str(c["page_id"]), "chunk_ix": c["chunk_ix"]}
                none = {"proposal": None, "status": None, "claims": [], "calls": 0, "input_tokens": 0, "output_tokens": 0, "response_ids": [], "events": []}
                why = "image_missing" if c["content"] is None else None if c["sound"] else "image_changed"
                if why is None:
                    crops = line_crops(lines, bytes(c["content"]), int(c["page_width"] or 0), int(c["page_height"] or 0), margin, mask)
                    units = {x["line_id"]: x["unit_id"] for x in lines if x.get("unit_id")}
                    shown = Shown(made, crops, units, capabilities.max_images)
                    found = producing.attempt(shown, lines, set(c["target_ids"]), policy, claims=claims, granularity=c["granularity"], plan=plan)
                else:
                    found = {i: none | {"reason": why} for i in c["target_ids"]}
                rows += [key | {"line_id": i} | r for i, r in found.items()]
            yield pd.DataFrame(rows, columns=producing._COLUMNS)

    return joined.select("doc_id", "page_id", "chunk_ix", "granularity", "lines", "target_ids", "content", "sound", "page_width", "page_height").mapInPandas(
        run, producing.PRODUCED)
