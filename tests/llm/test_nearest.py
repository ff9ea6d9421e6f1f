import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.llm.nearest import nearest_match

T0 = dt.datetime(2024, 1, 1, 9)


def s(seconds):
    return T0 + dt.timedelta(seconds=seconds)


LEFT, RIGHT = "q bigint, k string, t timestamp_ntz", "i bigint, k string, t timestamp_ntz"
HOW = {"left_key": "k", "left_time": "t", "left_id": "q", "right_key": "k", "right_time": "t", "right_id": "i"}


def _brute(left, right, tol):
    out = []
    for q, k, t in left:
        best = min(((abs(t - u), u, i) for i, j, u in right if j == k and k is not None and u is not None and t is not None and abs(t - u) <= tol), default=None)
        out.append((q, best[2] if best else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seconds", [0, 1, 2, 40, 5_000])
def test_nearest_against_brute_force(spark, seconds):
    r = random.Random(seconds)
    right = [(i, r.choice("ab"), s(r.randint(0, 900)) if r.random() > 0.05 else None) for i in range(150)]
    left = [(i, r.choice(["a", "b", "c", None]), s(r.randint(-50, 1_000)) if r.random() > 0.05 else None) for i in range(150)]
    tol = dt.timedelta(seconds=seconds)
    out = nearest_match(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), **HOW, tolerance=tol, keep_unmatched=True)
    assert sorted(((x.left_id, x.right_id) for x in out.collect()), key=str) == _brute(left, right, tol)
    kept = nearest_match(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), **HOW, tolerance=tol)
    assert sorted(((x.left_id, x.right_id) for x in kept.collect()), key=str) == [x for x in _brute(left, right, tol) if x[1] is not None]


def test_nearest_ties_and_edges(spark):
    right = spark.createDataFrame([(5, "a", s(0)), (3, "a", s(0)), (7, "a", s(4)), (9, "a", s(100))], RIGHT).withColumn("bin", F.lit("x"))
    left = spark.createDataFrame([(1, "a", s(2)), (1, "a", s(2)), (2, "a", s(6)), (3, "a", s(103))], LEFT).withColumn("us", F.lit(0))
    got = sorted((x.left_id, x.right_id, x.offset_us) for x in nearest_match(left, right, **HOW, tolerance="2s").collect())
    assert got == [(1, 3, -2_000_000), (1, 3, -2_000_000), (2, 7, -2_000_000)]
    none = spark.createDataFrame([], RIGHT)
    assert nearest_match(left, none, **HOW, tolerance="2s").count() == 0
    assert nearest_match(left, none, **HOW, tolerance="2s", keep_unmatched=True).count() == 4
    assert nearest_match(spark.createDataFrame([], LEFT), right, **HOW, tolerance="2s").count() == 0
    with pytest.raises(ValueError):
        nearest_match(left, right, **HOW, tolerance="1mo")
