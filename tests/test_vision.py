"""Boxes, margins and images of pages."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lectern.operators import vision


def test_boxes(spark):
    df = spark.createDataFrame([(0, (10, 20, 100, 10)), (1, (-50, -50, 10, 10)), (2, (990, 0, 500, 4))], "i int, b struct<hpos:int,vpos:int,width:int,height:int>")
    two = F.lit(0.5)
    box = vision.clamped(vision.with_margin(vision.to_pixels(F.col("b"), two, two, F.lit(0.0), F.lit(0.0)), 0.1), F.lit(500), F.lit(400))
    got = [tuple(r[0]) for r in df.orderBy("i").select(box).collect()]
    assert got == [(0, 10, 60, 16), (0, 0, 1, 1), (470, 0, 500, 2)]


def test_polygon(spark):
    df = spark.createDataFrame([("10,20 x 30,40", (5, 10, 50, 50))], "p string, c struct<left:int,top:int,right:int,bottom:int>")
    got = df.select(vision.polygon_in_crop(F.col("p"), F.lit(1.0), F.lit(0.5), F.col("c"))).first()[0]
    assert [tuple(x) for x in got] == [(5.0, 0.0), (25.0, 10.0)]


def test_images(spark):
    good = "sha256:" + hashlib.sha256(b"abc").hexdigest()
    pages = spark.createDataFrame([("p",)], "page_id string")
    images = spark.createDataFrame([("p", bytearray(b"abc"), good)], "page_id string, content binary, digest string")
    assert vision.with_images(pages, images).count() == 1
    with pytest.raises(vision.ImageError):
        vision.with_images(pages, images.withColumn("digest", F.lit("sha256:0")))
    with pytest.raises(vision.ImageError):
        vision.with_images(spark.createDataFrame([("q",)], "page_id string"), images)
