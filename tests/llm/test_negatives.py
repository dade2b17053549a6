"""Hard negatives against all pairs, the curve, and bounds of boxes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dagtrail.llm import hilbert, negatives


def simple(found, positives=5, kept=3):
    usable = []
    for vec_id, vector, label in found:
        if vec_id is not None and label is not None and vector is not None:
            if all(x is not None and math.isfinite(x) for x in vector):
                usable.append((vec_id, label, [math.floor(256 * x) for x in vector]))
    score = lambda x, y: sum(p * q for p, q in zip(x, y, strict=False))
    answer = []
    for i, (anchor, label, v) in enumerate(usable):
        if anchor % 50:
            continue
        others = [(-score(v, w), j, m) for k, (j, m, w) in enumerate(usable) if k != i]
        for p, positive, _ in sorted(x for x in others if x[2] == label)[:positives]:
            near = sorted(x for x in others if x[2] != label and -50 * p <= -100 * x[0] <= -95 * p)[:kept]
            answer += [(anchor, positive, rank + 1, j, -p, -s) for rank, (s, j, _) in enumerate(near)]
    return sorted(answer)


def found_by(spark, found, **given):
    df = spark.createDataFrame(found, "vec_id long, embedding array<double>, label int").repartition(3)
    df = df.selectExpr("*", "'other' as block", "'other' as row", "'other' as tile")
    rows = negatives.integer_rows(df, F.col("label"))
    answer = negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0, **given)
    order = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(map(tuple, answer.select(*order).collect()))


def vectors(n, width=5):
    rnd = random.Random(n)
    made = [(i, [rnd.choice([-1, 1]) * rnd.random() for _ in range(width)], i % 3) for i in range(n)]
    # ties, one vector that is very common, repeated rows, short vectors, zeros
    made += [(n + i, made[0][1], i % 2) for i in range(n // 2)] + made[:60]
    made += [(5000, [0.0] * width, 0), (5001, [0.0] * width, 1), (5050, [0.5], 0), (None, [1.0] * width, 0), (5100, None, 0)]
    return made + [(5150, [1.0, None], 0), (5200, [float("nan")] * width, 0), (5250, [math.inf], 1), (5300, [1.0] * width, None)]


@pytest.mark.parametrize("block_rows", [7, 512])
def test_against_all_pairs(spark, monkeypatch, block_rows):
    monkeypatch.setattr(negatives, "TILE_BLOCKS", 5)
    monkeypatch.setattr(negatives, "TILE_ANCHORS", 4)
    found = vectors(300)
    assert found_by(spark, found, block_rows=block_rows) == simple(found)


def test_few_rows(spark):
    assert found_by(spark, []) == []
    found = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.75], 2)]
    assert found_by(spark, found) == [(0, 1, 1, 2, 65536, 49152)]
    assert found_by(spark, found[:1]) == []


def test_bounds_leave_blocks_unread(spark):
    rnd = random.Random(5)
    found = [(i, [math.cos(a), math.sin(a)], 0) for i, a in enumerate(rnd.random() * 6.28 for _ in range(2000))]
    rows = negatives.integer_rows(spark.createDataFrame(found, "vec_id long, embedding array<double>, label int"), F.col("label"))
    blocks = negatives.write_blocks(rows, 2, 20)
    wanted = rows.where("vec_id % 50 = 0").selectExpr(
        "0L as tile", "row as anchor", "vec_id as anchor_id", "label", "vector", "array(65000L) as at_least", "array(70000L) as at_most"
    )
    chosen = negatives._chosen(wanted, blocks, 2, True)
    assert 0 < chosen.count() < 0.1 * wanted.count() * blocks.count()
    # no candidate that is good enough lies in a block left out
    of = {r.row: r.block for r in blocks.selectExpr("block", "explode(rows) as row").collect()}
    read = {(r.anchor, r.block) for r in chosen.collect()}
    whole = {r.row: r.vector for r in rows.collect()}
    for r in wanted.collect():
        for row, v in whole.items():
            if 65000 <= v[0] * r.vector[0] + v[1] * r.vector[1] <= 70000:
                assert (r.anchor, of[row]) in read


def test_bounds_hold_every_product():
    rnd = np.random.default_rng(3)
    points, anchors = rnd.integers(-50, 50, (40, 6)), rnd.integers(-50, 50, (9, 6))
    low, high = negatives.bounds(anchors, points.min(axis=0)[None], points.max(axis=0)[None])
    assert (low <= anchors @ points.T).all() and (anchors @ points.T <= high).all()
    huge = negatives.bounds(np.array([[1 << 31]]), np.array([[-(1 << 30) - 1]]), np.array([[1 << 30]]))
    assert [int(h[0, 0]) for h in huge] == [-(1 << 31) * ((1 << 30) + 1), 1 << 61]


@pytest.mark.parametrize("axes, bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_the_curve_goes_from_neighbour_to_neighbour(axes, bits):
    grid = np.array(np.meshgrid(*[range(1 << bits)] * axes)).reshape(axes, -1).T
    key = hilbert.positions(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
