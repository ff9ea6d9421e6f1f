import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom import Config
from tickloom.operators.dynamic_labels import apply_profit_taking_stop_loss, daily_vol, first_at_least, get_triple_barrier_label, get_vertical_barrier_by_timedelta, price_level
from tickloom.operators.frac_diff import frac_diff, frac_diff_weights
from tickloom.operators.labels import fixed_time_return, fixed_time_return_classification

D = dt.datetime
TIMES = [D(2024, 1, 1, h) for h in (0, 3, 6, 9, 15, 20)] + [D(2024, 1, 2, 1)] + [D(2024, 1, 3, h) for h in (5, 7, 9)]


@pytest.fixture
def five(spark):
    t = [0.7, 0.3, 0.1, 0.3, 0.3]
    return spark.createDataFrame([(i, float(i), sy, t[i - 1]) for sy in "AB" for i in range(1, 6)], "ts int, p double, sy string, t double")


def _by_symbol(df, column):
    out = {}
    for r in df.select("sy", "ts", column.alias("x")).orderBy("sy", "ts").collect():
        out.setdefault(r.sy, []).append(r.x)
    return out


def test_fixed_time_return(five):
    assert _by_symbol(five, fixed_time_return("p", 1, symbol="sy", order_by="ts")) == {s: [0.5, pytest.approx(1 / 3), 0.25, None, None] for s in "AB"}


@pytest.mark.parametrize(("threshold", "labels"), [(0.3, [1, 1, 0, None, None]), (-0.3, [1, 1, 0, None, None]), (None, [1, 1, 1, None, None]), ("t", [0, 1, 1, None, None]), (0.5, [0, 0, 0, None, None])])
def test_classification(five, threshold, labels):
    assert _by_symbol(five, fixed_time_return_classification("p", 1, threshold, symbol="sy", order_by="ts")) == {s: labels for s in "AB"}


def test_label_edges(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 5.0), (4, float("nan")), (5, 2.0), (6, 1.0), (7, None)], "ts int, p double")
    got = [r[0] for r in df.select("ts", fixed_time_return_classification("p", 1, 0.1, 0, order_by="ts").alias("x")).orderBy("ts").select("x").collect()]
    assert got == [-1, None, 1, 1, -1, None, None]
    sign = [r[1] for r in df.select("ts", fixed_time_return_classification("p", 1, None, 0, order_by="ts")).orderBy("ts").collect()]
    assert sign == [-1, None, None, None, -1, None, None]


def test_daily_vol_golden(spark):
    with Config(timestamp_column="ts_event"):
        out = daily_vol(spark.createDataFrame([(t, i + 1) for i, t in enumerate(TIMES)], "ts_event timestamp_ntz, price bigint"), span=3)
        got = [r.daily_return_volatility for r in out.orderBy("ts_event").collect()]
    assert got[:6] == [None] * 6 and got[6:] == pytest.approx([0.0, 4.141625, 2.668519, 1.792192], abs=1e-6)


def test_daily_vol_per_symbol_and_dirty(spark):
    data = [(t, p * f, s) for s, f in (("A", 1.0), ("B", 2.0)) for t, p in zip(TIMES, [1.0, 2.0, None, 4.0, 5.0, 0.0, 7.0, 8.0, 9.0, 10.0]) if p is not None] + [(None, 1.0, "A"), (TIMES[0], 1.0, None)]
    out = daily_vol(spark.createDataFrame(data, "timestamp timestamp_ntz, price double, symbol string").withColumn("us", F.lit(1)), span=3)
    assert out.columns == ["timestamp", "symbol", "daily_return_volatility"] and out.count() == len(data)
    by = {}
    for r in out.where("symbol is not null and timestamp is not null").orderBy("timestamp").collect():
        by.setdefault(r.symbol, []).append(r[2])
    assert [x is None for x in by["A"]] == [x is None for x in by["B"]]
    assert [x for x in by["A"] if x is not None] == pytest.approx([x for x in by["B"] if x is not None])
    p = pd.Series([r[1] for r in data if r[2] == "A" and r[0]], index=[r[0] for r in data if r[2] == "A" and r[0]])
    ret = pd.Series([p[t] / p[p.index <= t - dt.timedelta(days=1)].iloc[-1] - 1 if (p.index <= t - dt.timedelta(days=1)).any() else None for t in p.index], dtype=float)
    want = ret.ewm(span=3).std().fillna(0).where(ret.notna())
    assert [None if pd.isna(x) else pytest.approx(x) for x in want] == by["A"]
    assert daily_vol(spark.createDataFrame([], "timestamp timestamp_ntz, price double")).count() == 0


@pytest.mark.parametrize(("offset", "last"), [("2h", [TIMES[8], TIMES[9], None]), ("3h", [TIMES[9], None, None]), (dt.timedelta(hours=2), [TIMES[8], TIMES[9], None])])
def test_vertical_barrier(spark, offset, last):
    with Config(timestamp_column="ts_event"):
        df = spark.createDataFrame([(t,) for t in reversed(TIMES)], "ts_event timestamp_ntz")
        got = [r.vertical_barrier for r in get_vertical_barrier_by_timedelta(df, offset).orderBy("ts_event").collect()]
    assert got == [*TIMES[1:8], *last]


def test_vertical_barrier_symbols_and_months(spark):
    df = spark.createDataFrame([(D(2024, 1, 31), "A"), (D(2024, 2, 29), "A"), (D(2024, 3, 31), "B"), (None, "A")], "timestamp timestamp_ntz, symbol string")
    got = {(r.symbol, r.timestamp): r.vertical_barrier for r in get_vertical_barrier_by_timedelta(df, "1mo").collect()}
    assert got == {("A", D(2024, 1, 31)): D(2024, 2, 29), ("A", D(2024, 2, 29)): None, ("B", D(2024, 3, 31)): None, ("A", None): None}
    with pytest.raises(TypeError):
        get_vertical_barrier_by_timedelta(df, 3)


def test_weights():
    assert len(frac_diff_weights(0.5, 1e-3)) == 44 and len(frac_diff_weights(0.5, 1e-5)) == 927
    assert frac_diff_weights(1, 1e-3) == [-1.0, 1.0] and frac_diff_weights(0.3, 2.0) == [1.0]
    for bad in (0, -1):
        with pytest.raises(ValueError):
            frac_diff_weights(0.5, bad)


def test_frac_diff(spark):
    data = [(s, i, float(i * i % 17 + 1)) for s in "AB" for i in range(60)]
    df = spark.createDataFrame(data, "s string, i int, p double")
    w = frac_diff_weights(0.5, 1e-2)
    got = df.select("s", "i", frac_diff("p", 0.5, 1e-2, order_by="i", partition_by=["s"]).alias("f")).orderBy("s", "i").collect()
    p = [d[2] for d in data[:60]]
    want = [None if i < len(w) - 1 else pytest.approx(sum(a * b for a, b in zip(w, p[i - len(w) + 1 : i + 1]))) for i in range(60)]
    assert [r.f for r in got] == want * 2
    assert all(r[0] is None for r in df.select(frac_diff("p", 0.5, 1e-5, order_by="i", partition_by=["s"])).collect())
    with pytest.raises(Exception, match="null value"):
        df.select(frac_diff(F.when(F.col("i") != 3, F.col("p")), 0.5, order_by="i", partition_by=["s"])).collect()


def test_triple_barrier(spark):
    t = [D(2024, 1, 1, h) for h in range(6)]
    prices = spark.createDataFrame(list(zip(t, [100.0, 101.0, 106.0, 94.0, 100.0, 102.0], "A" * 6)), "timestamp timestamp_ntz, price double, symbol string")
    events = spark.createDataFrame([(t[0], "A", 0.05, t[4]), (t[2], "A", 0.05, t[4]), (t[4], "A", 0.05, None), (t[0], "A", 0.05, t[1]), (t[0], "Z", 0.05, t[1])], "timestamp timestamp_ntz, symbol string, target double, vb timestamp_ntz")
    got = sorted((r.symbol, r.timestamp, r.touch_timestamp, None if r[3] is None else round(r[3], 4), r.label) for r in get_triple_barrier_label(events, prices, "target", "vb", 1.0, 1.0).collect())
    assert got == [("A", t[0], t[1], 0.01, 0), ("A", t[0], t[2], 0.06, 1), ("A", t[2], t[3], round(94 / 106 - 1, 4), -1), ("A", t[4], t[5], 0.02, 0), ("Z", t[0], t[1], None, None)]
    touched = apply_profit_taking_stop_loss(events, prices, "target", "vb", 1.0, 1.0).where("symbol = 'A'").select("timestamp", "vb", "profit_take_touch", "stop_loss_touch").collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in touched}[t[0], t[4]] == (t[2], t[3])
    signs = get_triple_barrier_label(events, prices, "target", "vb", 1.0, 1.0, zero_at_vertical=False)
    assert signs.where("symbol = 'A' and timestamp = '2024-01-01 04:00:00'").first().label == 1


def test_first_at_least_and_levels():
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 100):
        v = r.integers(0, 20, n).astype(float)
        lo = r.integers(0, n + 1, 200)
        hi = np.maximum(lo, r.integers(0, n + 1, 200))
        level = r.integers(0, 25, 200).astype(float)
        want = [next((i for i in range(a, b) if v[i] >= x), b) for a, b, x in zip(lo, hi, level)]
        assert first_at_least(v, level, lo, hi).tolist() == want
    start, ret = r.integers(1, 9_999, 5_000) / 100, np.full(5_000, 0.5)
    up, down = price_level(start, ret, True), price_level(start, -ret, False)
    assert (up / start - 1 >= 0.5).all() and (np.nextafter(up, -np.inf) / start - 1 < 0.5).all()
    assert (down / start - 1 <= -0.5).all() and (np.nextafter(down, np.inf) / start - 1 > -0.5).all()
    assert price_level(np.array([0.0, np.nan, 1.0]), np.array([0.1, 0.1, np.nan]), True).tolist() == [np.inf] * 3
