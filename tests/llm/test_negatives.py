"""Hard negatives against plain Python over all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantcast.llm import negatives

ROW = "vec_id long, embedding array<float>, label int"


def brute(rows, is_anchor, k=5, scale=256):
    usable = {
        (i, label, tuple(math.floor(scale * float(np.float32(v))) for v in x))
        for i, x, label in rows
        if i is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)
    }
    out = []
    for i, label, q in usable:
        if not is_anchor(i):
            continue
        score = [(-sum(a * b for a, b in zip(q, r, strict=True)), j, own) for j, own, r in usable if len(r) == len(q)]
        for p, j, _ in sorted(s for s in score if s[2] == label and s[1] != i)[:k]:
            fits = sorted((s, m) for s, m, own in score if own != label and 80 * -p <= 100 * -s <= 100 * -p)
            out += [(i, j, n + 1, m, -p, -s) for n, (s, m) in enumerate(fits[:k])]
    return sorted(out)


def vectors(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    return [(i, (centres[i % 4] + spread * rng.normal(size=dim)).tolist(), int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("seed,dim,spread", [(0, 16, 1.0), (1, 64, 0.2), (2, 3, 0.0)])
def test_against_all_pairs(spark, seed, dim, spread):
    rows = vectors(2_500, dim, seed, spread)
    rows = [(i, [round(v, 1) for v in x] if seed == 2 else x, label) for i, x, label in rows]
    got = negatives.hard_negatives(spark.createDataFrame(rows, ROW), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 100 == 0)


def test_several_tiles_give_the_same(spark, monkeypatch):
    rows = vectors(600, 8, 3)
    df = spark.createDataFrame(rows, ROW)
    one = sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 50 == 0).collect()))
    monkeypatch.setattr(negatives, "TILE", 40)
    assert sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 50 == 0).collect())) == one


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 1.0, -1.0, 2.0]) for _ in range(4)], i % 3) for i in range(1, 60)]
    rows += [
        (100, None, 1), (200, [1.0, None, 0.0, 0.0], 1), (300, [1.0, float("nan"), 0.0, 0.0], 1), (400, [float("inf"), 0.0, 0.0, 0.0], 0),
        (500, [1.0, 2.0, 0.0, 1.0], None), (None, [1.0, 1.0, 1.0, 1.0], 1), (600, [0.0, 0.0, 0.0, 0.0], 2), (700, [1.0, 1.0, 1.0, 0.0], 0),
        (800, [], 0), (801, [], 0), (802, [], 1), (900, [3.0, 1.0], 1), (901, [3.0, 1.0], 1), (902, [2.5, 1.0], 2),
    ]
    df = spark.createDataFrame(rows, ROW).withColumns({"anchor": F.lit("x"), "block": F.lit(1.5), "ends": F.lit(None)})
    got = sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect()))
    assert got == brute(rows, lambda i: i % 100 == 0)
    assert {r[0] for r in got} == {600, 700, 800, 900}


def test_repeated_rows_and_empty_table(spark):
    rows = [(0, [1.0], 0), (0, [1.0], 0), (1, [1.0], 0), (1, [1.0], 0), (2, [0.9], 1), (2, [0.9], 1), (3, [-1.0], 1)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, ROW), F.col("vec_id") == 0, positives=3)
    by = sorted(map(tuple, got.collect()))
    assert [(r[1], r[2], r[3]) for r in by] == [(1, 1, 2), (1, 1, 2), (1, 2, 2), (1, 2, 2)]
    assert negatives.hard_negatives(spark.createDataFrame([], ROW), F.col("vec_id") == 0).collect() == []


def test_huge_components(spark):
    """Scores beyond 53 bits stay exact; components beyond the range take no part."""
    big = float((1 << 22) - 64)
    rows = [(0, [big] * 600, 0), (1, [big - 1] * 600, 0), (2, [big - 3] * 600, 1), (3, [big - 4] * 599 + [big - 3], 1), (4, [1e30] * 600, 1)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0, scale=1.0)
    b = int(big)
    exact = [b * (b - 3) * 600, b * ((b - 4) * 599 + b - 3)]
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, k + 1, 2 + k, b * (b - 1) * 600, s) for k, s in enumerate(exact)]
