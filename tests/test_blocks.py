import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tickloom.functions.durations import from_micros
from tickloom.operators import sharding
from tickloom.operators.blocks import asof, ewm_std, over_blocks, running_totals
from tickloom.operators.frac_diff import add_frac_diff, frac_diff
from tickloom.operators.labels import add_fixed_time_return, fixed_time_return

HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def series(spark):
    r = random.Random(5)
    data = [(i, r.choice(["a"] * 8 + ["b", None]), r.randint(0, 60 * HOUR), float(r.randint(1, 90)), r.randint(1, 9)) for i in range(900)]
    df = spark.createDataFrame(data, "id bigint, k string, us bigint, x double, n bigint").withColumn("timestamp", from_micros(F.col("us"))).withColumns({"__rn": F.lit("x"), "__block": F.lit(0), "__amount": F.lit(1)})
    return data, df


def test_running_totals(series):
    data, df = series
    keyed = df.where("k is not null").withColumns({"h": F.floor(F.col("us") / HOUR), "o": F.struct("us", "id")})
    got = {r.id: r.total for r in running_totals(keyed, ["k"], "h", "o", F.col("n"), "total").collect()}
    want = {}
    for k in "ab":
        total = 0
        for d in sorted((d for d in data if d[1] == k), key=lambda d: (d[2], d[0])):
            total += d[4]
            want[d[0]] = total
    assert got == want


@pytest.mark.parametrize("block", [40, 200, 10_000])
def test_blocks_equal_whole_windows(series, block):
    _, df = series
    order = ["timestamp", "id"]
    whole = df.select("id", frac_diff("x", 0.5, 5e-2, order_by=order, partition_by=["k"]).alias("f"), fixed_time_return("x", 3, 2, "k", order_by=order).alias("r"), fixed_time_return("x", -2, -1, "k", order_by=order).alias("p"))
    d = add_frac_diff(df, "x", 0.5, 5e-2, out="f", tie_breakers=["id"], partition_by=["k"], block=block)
    d = add_fixed_time_return(d, "x", 3, 2, symbol="k", out="r", tie_breakers=["id"], block=block)
    d = add_fixed_time_return(d, "x", -2, -1, symbol="k", out="p", tie_breakers=["id"], block=block)
    assert rows(d.select("id", "f", "r", "p")) == rows(whole)
    assert d.columns == [*df.columns, "f", "r", "p"]


def test_blocks_edges(spark, series):
    _, df = series
    assert add_frac_diff(df.limit(0), "x", 0.5).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, None)], "x int, timestamp timestamp_ntz")
    assert over_blocks(nulls, lambda w: F.lead("x").over(w), "y", partition_by=[], order_by=["timestamp", "x"], time="timestamp", after=1).orderBy("x").select("y").collect() == [(2,), (None,)]
    with pytest.raises(ValueError):
        over_blocks(nulls, lambda w: F.lead("x").over(w), "y", partition_by=[], order_by=["x"], time="timestamp")


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("width", [HOUR, 30 * HOUR])
def test_asof(spark, series, forward, width):
    data, _ = series
    by = HOUR // 2
    plain = [(d[0], d[1] or "", d[2] if d[0] % 50 else None, d[0]) for d in data]
    df = spark.createDataFrame(plain, "id bigint, k string, us bigint, tie bigint").withColumn("value", F.col("id"))
    got = {r.id: r.found for r in asof(df, by, forward=forward, width=width).collect()}
    want = {}
    for i, k, us, _ in plain:
        fit = [(u, t) for _, q, u, t in plain if q == k and us is not None and u is not None and (u >= us + by if forward else u <= us - by)]
        want[i] = (min(fit) if forward else max(fit))[1] if fit else None
    assert got == want


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_ewm_std(spark, monkeypatch, shards):
    monkeypatch.setattr(sharding, "partitions_for", lambda df, mb: shards)
    r = random.Random(3)
    data = [(k, i, 1e3 + r.random() if r.random() > 0.2 else None) for k, n in (("a", 400), ("b", 30), ("c", 1)) for i in range(n)]
    got = {(x.k, x.i): x.s for x in ewm_std(spark.createDataFrame(data, "k string, i int, x double"), "k", ["i"], "x", 20, ["k", "i"], "s").collect()}
    for k in "abc":
        x = pd.Series([d[2] for d in data if d[0] == k], dtype=float)
        want = x.ewm(span=20).std().fillna(0).where(x.notna())
        mine = np.array([got[k, i] if got[k, i] is not None else np.nan for i in range(len(x))])
        np.testing.assert_allclose(mine, want, rtol=1e-6, atol=1e-9)
