"""Geometry and identity of page images, natively; pixels themselves are left to the caller's client.

A line's box in the file's units becomes a box in pixels by scale and offset, grows by a margin
and is clamped to the image; images are joined to pages by id and refused if their bytes have changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


class ImageError(ValueError):
    """A page without its image, or an image whose bytes have moved."""


def to_pixels(box: Column, scale_x: Column, scale_y: Column, dx: Column, dy: Column) -> Column:
    """(hpos, vpos, width, height) -> (left, top, right, bottom) in pixels, unrounded."""
    left, top = box["hpos"] * scale_x + dx, box["vpos"] * scale_y + dy
    return F.struct(left.alias("left"), top.alias("top"), (left + box["width"] * scale_x).alias("right"),
                    (top + box["height"] * scale_y).alias("bottom"))


def with_margin(box: Column, ratio: float) -> Column:
    """A box grown on every side by a share of its width and height."""
    x, y = (box["right"] - box["left"]) * ratio, (box["bottom"] - box["top"]) * ratio
    return F.struct((box["left"] - x).alias("left"), (box["top"] - y).alias("top"), (box["right"] + x).alias("right"), (box["bottom"] + y).alias("bottom"))


def clamped(box: Column, width: Column, height: Column) -> Column:
    """Whole pixels inside the image, one by one at least."""
    left = F.greatest(F.lit(0), F.least(F.bround(box["left"]).cast("int"), width - 1))
    top = F.greatest(F.lit(0), F.least(F.bround(box["top"]).cast("int"), height - 1))
    right = F.greatest(left + 1, F.least(F.bround(box["right"]).cast("int"), width))
    bottom = F.greatest(top + 1, F.least(F.bround(box["bottom"]).cast("int"), height))
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


def polygon_in_crop(points: Column, scale_x: Column, scale_y: Column, crop: Column) -> Column:
    """A polygon's points in the crop's own pixels; malformed points are skipped."""
    pairs = F.filter(F.split(points, f"{T.SPACE}+"), lambda p: p.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?,[+-]?[0-9]+(\.[0-9]*)?$"))
    return F.transform(pairs, lambda p: F.struct(
        (F.split(p, ",")[0].cast("double") * scale_x - crop["left"]).alias("x"),
        (F.split(p, ",")[1].cast("double") * scale_y - crop["top"]).alias("y")))


def with_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """``pages`` joined to ``images`` (page_id, content, digest); every page needs an image whose bytes still have its digest."""
    lost = pages.join(images, "page_id", "left_anti").limit(5).collect()
    if lost:
        raise ImageError(f"pages without an image: {[r['page_id'] for r in lost]}")
    moved = images.where(F.col("digest") != T.source_digest(F.col("content"))).limit(5).collect()
    if moved:
        raise ImageError(f"images that have changed: {[r['page_id'] for r in moved]}")
    return pages.join(images, "page_id")
