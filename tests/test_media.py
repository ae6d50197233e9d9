import random

import numpy as np
from pyspark.sql import functions as F

from oriel.functions import geometry as G
from oriel.functions import masks as K
from oriel.functions import media as M


def test_fill():
    m = M.fill_polygons([[(1, 1), (3, 1), (3, 3), (1, 3)]], 5, 5)
    assert m.sum() == 9 and m[1, 1] == m[3, 3] == 1 and m[0, 0] == 0
    both = M.fill_polygons([[(0, 0), (1, 0), (1, 1), (0, 1)], [(3, 3), (4, 3), (4, 4), (3, 4)]], 5, 5)
    assert both.sum() == 8 and M.fill_polygons(None, 2, 2).sum() == 0


def test_area_resize():
    assert np.allclose(M.area_resize(np.arange(16).reshape(4, 4), 2, 2), [[2.5, 4.5], [10.5, 12.5]])
    assert np.allclose(M.area_resize(np.array([[0, 3, 6]]), 1, 2), [[1, 5]])


def test_jpeg():
    head = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x20\x00\x10" + bytes(9)
    assert M.jpeg_size(head) == (16, 32) and M.jpeg_size(b"x") is None and M.jpeg_size(head[:6]) is None and M.jpeg_size(None) is None


def test_columns(spark):
    d = spark.range(1).select(F.expr("array(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1D, 'y', 0D), named_struct('x', 1D, 'y', 1D)))").alias("p"), F.unhex(F.lit("FFD8FFC0001108002000100000000000000000")).alias("c"))
    r = d.select(M.polygon_mask("p", F.lit(2), F.lit(2)).alias("m"), M.jpeg_dimensions("c").alias("s")).first()
    assert r["m"] == [1, 1, 1, 1] or sum(r["m"]) >= 3
    assert tuple(r["s"]) == (16, 32)


def test_runs_equal_pixel_arrays(spark):
    r, rows = random.Random(3), []
    for i in range(60):
        masks = [np.array([r.random() < p for _ in range(40)]) for p in (0.3, 0.7, r.choice([0, 1]))]
        rows.append((i, [[tuple(x) for x in K.runs_of(m)] for m in masks], [[int(v) for v in m] for m in masks]))
    run = "array<struct<start:bigint,stop:bigint>>"
    d = spark.createDataFrame(rows, f"i int, runs array<{run}>, masks array<array<int>>")
    a, b = F.col("runs")[0], F.col("runs")[1]
    got = d.select("masks", K.union_runs("runs").alias("u"), K.covered_pixels([a, b], 2).alias("both"), K.covered_pixels([a, b, F.col("runs")[2]], 1).alias("any"), K.run_iou(a, b).alias("iou"), K.run_coverage(a, F.lit(40)).alias("c"), G.binary_iou(F.col("masks")[0], F.col("masks")[1]).alias("want"))
    for x in got.collect():
        m = np.array(x["masks"])
        assert [tuple(y) for y in x["u"]] == [tuple(y) for y in K.runs_of(m.any(axis=0))]
        assert x["both"] == (m[0] & m[1]).sum() and x["any"] == m.any(axis=0).sum() and x["iou"] == x["want"] and x["c"] == m[0].mean()
    none = spark.createDataFrame([([], []), (None, [])], f"a {run}, b {run}").select(K.run_iou("a", "b").alias("iou"), K.pixels("a").alias("n")).collect()
    assert [tuple(x) for x in none] == [(1.0, 0), (None, None)]
