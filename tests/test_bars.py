import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tickloom import Config, bar_groups, dollar_bars, tick_bars, time_bars, volume_bars
from tickloom.operators.bars import BarScan, DollarScan

T0 = dt.datetime(2021, 1, 1)
SCHEMA = "symbol string, price double, size bigint, ts_event timestamp_ntz"


@pytest.fixture(autouse=True)
def names():
    with Config(timestamp_column="ts_event"):
        yield


@pytest.fixture(scope="module")
def trades(spark):
    r = random.Random(3)
    data = [(r.choice("AB"), r.randint(100, 200) / 4, r.randint(1, 40), T0 + dt.timedelta(seconds=r.randint(0, 2 * 86_400))) for _ in range(600)]
    return data, spark.createDataFrame(data, SCHEMA)


def test_single_trade_overflow(spark):
    one = spark.createDataFrame([("A", 3.0, 8, T0)], SCHEMA)
    for out in (volume_bars(one, bar_size=5), dollar_bars(one, bar_size=13.0)):
        got = sorted(tuple(r) for r in out.select("symbol", "ts_event_start", "ts_event_end", "open", "high", "low", "close", "vwap", "volume", "n_trades").collect())
        assert got == [("A", T0, T0, 3.0, 3.0, 3.0, 3.0, 3.0, v, 1) for v in (3, 5)]


def _overflow(values, size):
    """Bars of unit trades: a value goes whole to the current bar, which closes on reaching the size."""
    out, total, bar = [], 0, 0
    for v in values:
        out.append(bar)
        total += v
        if total >= size:
            total, bar = 0, bar + 1
    return out


@pytest.mark.parametrize(("values", "groups"), [([1, 2, 3, 4, 5], [0, 0, 0, 1, 2]), ([2, 2, 5, 1, 3], [0, 0, 1, 2, 2]), ([3, 3, 3, 3], [0, 0, 1, 1])])
def test_overflow_scan(values, groups):
    got = DollarScan(4.0).pieces([float(v) for v in values], [1] * len(values))[1].tolist()
    assert BarScan(4, False, "int64").pieces(np.array(values))[1].tolist() == got
    assert got == groups == _overflow(values, 4)


@pytest.mark.parametrize("kind", ["int32", "int64", "float32", "float64"])
@pytest.mark.parametrize(("values", "rows_", "groups", "amounts"), [([1, 2, 3, 4, 5], [0, 1, 2, 2, 3, 3, 4, 4], [0, 0, 0, 1, 1, 2, 2, 3], [1, 2, 1, 2, 2, 2, 2, 3]), ([3, 3, 3, 3], [0, 1, 1, 2, 2, 3], [0, 0, 1, 1, 2, 2], [3, 1, 2, 2, 1, 3])])
def test_split_groups(values, rows_, groups, amounts, kind):
    got = BarScan(4.0, True, kind).pieces(np.array(values, dtype=kind))
    assert [x.tolist() for x in got] == [rows_, groups, amounts] and got[2].dtype == kind


def _walk(values, size, splits):
    """Value by value."""
    out, total, group = [], type(size)(0), 0
    for i, v in enumerate(values):
        if not splits:
            out.append((i, group, v))
            total += v
            if total >= size:
                group, total = group + 1, type(size)(0)
            continue
        while v > 0:
            take = size - total if total + v >= size else v
            out.append((i, group, take))
            v -= take
            total += take
            if total >= size:
                group, total = group + 1, type(size)(0)
    return out


@pytest.mark.parametrize("splits", [True, False])
def test_bar_scan_against_a_walk(splits):
    r = np.random.default_rng(4)
    for n, top, size in ((200, 3, 50.0), (300, 40, 7.0), (50, 9, 4.0), (1_000, 2, 300.0)):
        values = r.integers(0 if splits else -1, 4 * top, n) / 4
        scan, got = BarScan(size, splits), []
        for a, b in ((0, n // 3), (n // 3, n // 3), (n // 3, n)):
            got += [(a + i, g, x) for i, g, x in zip(*(x.tolist() for x in scan.pieces(values[a:b])))]
        assert got == _walk(values.tolist(), size, splits)


@pytest.mark.parametrize("kind", ["bigint", "int", "double", "float", "decimal(10,2)"])
@pytest.mark.parametrize("splits", [True, False])
def test_bar_groups(spark, trades, kind, splits):
    data, df = trades
    typed = df.withColumn("size", F.col("size").cast(kind)).withColumn("__key", F.lit("x"))
    out = bar_groups(typed, "size", 50.0, allow_splits=splits, partition_by=["symbol"], order_by=["ts_event", "price", "size"])
    assert out.columns == [*typed.columns, "bar_group__id", "bar_group__amount"]
    got = sorted((x.symbol, x.bar_group__id, x.ts_event, x.price, float(x.bar_group__amount)) for x in out.collect())
    want = []
    for s in "AB":
        own = sorted((d for d in data if d[0] == s), key=lambda d: (d[3], d[1], d[2]))
        want += [(s, g, own[i][3], own[i][1], float(a)) for i, g, a in _walk([d[2] for d in own], 50, splits)]
    assert got == sorted(want)


def test_bar_groups_edges(spark):
    df = spark.createDataFrame([("A", None, 1), ("A", 0.0, 2), ("A", -1.0, 3), ("A", 9.0, 4), (None, 5.0, 1)], "s string, x double, t int")
    split = bar_groups(df, "x", 4.0, partition_by=["s"], order_by=["t"])
    assert rows(split.select("s", "t", "bar_group__id", "bar_group__amount")) == [("A", 4, 0, 4.0), ("A", 4, 1, 4.0), ("A", 4, 2, 1.0), (None, 1, 0, 4.0), (None, 1, 1, 1.0)]
    whole = bar_groups(df, "x", 4.0, allow_splits=False, partition_by=["s"], order_by=["t"])
    assert rows(whole.select("s", "t", "bar_group__id", "bar_group__amount")) == [("A", 1, 0, 0.0), ("A", 2, 0, 0.0), ("A", 3, 0, -1.0), ("A", 4, 0, 9.0), (None, 1, 0, 5.0)]
    assert bar_groups(df.limit(0), "x", 4.0, order_by=["t"]).count() == 0
    for bad in ({"bar_size": 0.0}, {"measure": "s"}, {"measure": "no"}, {"order_by": []}, {"measure": "t", "bar_size": 0.5}):
        with pytest.raises(ValueError):
            bar_groups(df, **({"measure": "x", "bar_size": 4.0, "order_by": ["t"]} | bad))
    with pytest.raises(ValueError):
        bar_groups(df.withColumn("bar_group__id", F.lit(1)), "x", 4.0, order_by=["t"])


def test_volume_bars_of_fractions(trades):
    """Quarter sizes with a quarter bar are the whole ones; float and double alike."""
    _, df = trades
    whole = {(r.symbol, r.ts_event_start, r.ts_event_end, r.open, r.close, r.n_trades) for r in volume_bars(df, bar_size=120).collect()}
    for kind in ("double", "float"):
        part = volume_bars(df.withColumn("size", (F.col("size") / 4).cast(kind)), bar_size=30)
        assert {(r.symbol, r.ts_event_start, r.ts_event_end, r.open, r.close, r.n_trades) for r in part.collect()} == whole


@pytest.mark.parametrize(("values", "pieces"), [([1, 2, 3, 4, 5], [(0, 3), (1, 2), (2, 2), (3, 1)]), ([3, 3, 3, 3], [(0, 2), (1, 2), (2, 2)])])
def test_split_scan(spark, values, pieces):
    df = spark.createDataFrame([("A", 1.0, v, T0 + dt.timedelta(seconds=i)) for i, v in enumerate(values)], SCHEMA)
    out = volume_bars(df, bar_size=4, sort=True).select("volume", "n_trades").collect()
    assert [r.n_trades for r in out] == [n for _, n in pieces]
    assert [r.volume for r in out[:-1]] == [4] * (len(pieces) - 1) and sum(r.volume for r in out) == sum(values)


def test_dollar_pieces_against_shares():
    r = random.Random(5)
    for _ in range(200):
        prices = [float(r.randint(0, 9)) for _ in range(r.randint(1, 8))]
        sizes = [r.randint(1, 12) for _ in prices]
        size = float(r.randint(1, 30))
        shares = [(i, p) for i, (p, n) in enumerate(zip(prices, sizes)) for _ in range(n)]
        want = pd.Series(list(zip([i for i, _ in shares], _overflow([p for _, p in shares], size)))).value_counts().to_dict()
        got = {}
        scan, half = DollarScan(size), len(prices) // 2
        for first, part in ((0, slice(0, half)), (half, slice(half, None))):  # the state carries over batches
            for i, bar, n in zip(*(x.tolist() for x in scan.pieces(prices[part], sizes[part]))):
                got[first + i, bar] = got.get((first + i, bar), 0) + n
        assert got == want, (prices, sizes, size)


def test_time_bars_against_pandas(trades):
    data, df = trades
    p = pd.DataFrame(data, columns=["symbol", "price", "size", "ts"]).sort_values(["ts", "price", "size"])
    p["bucket"] = p.ts.dt.floor("1h")
    want = p.groupby(["bucket", "symbol"]).agg(open=("price", "first"), high=("price", "max"), low=("price", "min"), close=("price", "last"), volume=("size", "sum"), n=("size", "size"))
    got = {(r.ts_event, r.symbol): (r.open, r.high, r.low, r.close, r.volume, r.n_trades) for r in time_bars(df, bar_size="1h").collect()}
    assert got == {(k[0].to_pydatetime(), k[1]): tuple(v) for k, v in zip(want.index, want.itertuples(index=False))}


@pytest.mark.parametrize("split", [True, False])
def test_tick_bars_against_pandas(trades, split):
    data, df = trades
    p = pd.DataFrame(data, columns=["symbol", "price", "size", "ts"]).sort_values(["ts", "price", "size"])
    keys = ["symbol", p.ts.dt.date] if split else ["symbol"]
    p["bar"] = p.groupby(keys).cumcount() // 7
    want = p.groupby([*keys, "bar"]).agg(open=("price", "first"), close=("price", "last"), volume=("size", "sum"), n=("size", "size"), start=("ts", "min"))
    got = sorted((r.ts_event_start, r.open, r.close, r.volume, r.n_trades) for r in tick_bars(df, bar_size=7, split_by_date=split).collect())
    assert got == sorted((r.start.to_pydatetime(), r.open, r.close, r.volume, r.n) for r in want.itertuples())


@pytest.mark.parametrize("split", [True, False])
@pytest.mark.parametrize("make", [volume_bars, dollar_bars])
def test_volume_is_kept(trades, make, split):
    data, df = trades
    out = make(df, bar_size=300, split_by_date=split)
    assert out.agg(F.sum("volume")).first()[0] == sum(d[2] for d in data)


def test_dollar_bars_over_small_batches(spark, trades):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = rows(dollar_bars(trades[1], bar_size=900.0, split_by_date=False))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == rows(dollar_bars(trades[1], bar_size=900.0, split_by_date=False))


def test_dirty_rows(spark):
    df = spark.createDataFrame([("A", None, 5, T0), ("A", 2.0, None, T0), ("A", 3.0, 0, T0), (None, 4.0, 6, T0), ("A", float("nan"), 1, T0), ("A", 5.0, 2, None)], SCHEMA)
    t = {r.symbol: r for r in time_bars(df, bar_size="1d").collect()}
    assert (t["A"].n_trades, t["A"].volume, t["A"].high, t[None].volume) == (3, 1, 3.0, 6)
    assert sum(r.volume for r in volume_bars(df, bar_size=2).collect()) == 9
    assert sum(r.volume for r in dollar_bars(df, bar_size=2.0).collect()) == 9
    assert sum(r.n_trades for r in tick_bars(df, bar_size=2).collect()) == 5


def test_empty_and_extra_columns(spark, trades):
    empty = spark.createDataFrame([], SCHEMA)
    for make in (time_bars, tick_bars, volume_bars, dollar_bars):
        assert make(empty).count() == 0
        assert rows(make(trades[1].withColumn("open", F.lit("x")).withColumn("vwap", F.lit(None)))) == rows(make(trades[1]))


def test_default_timestamp_name(spark):
    with Config(timestamp_column="timestamp"):
        df = spark.createDataFrame([("A", 1.0, 2, T0)], SCHEMA.replace("ts_event", "timestamp"))
        assert time_bars(df).columns[:4] == ["timestamp", "symbol", "timestamp_start", "timestamp_end"]
        assert tick_bars(df).columns[:3] == ["symbol", "timestamp_start", "timestamp_end"]


def test_errors(spark, trades):
    for make in (tick_bars, volume_bars, dollar_bars):
        with pytest.raises(ValueError):
            make(trades[1], bar_size=0)
    with pytest.raises(ValueError, match="missing"):
        time_bars(trades[1].drop("price"))
    with pytest.raises(ValueError, match="integral"):
        dollar_bars(trades[1].withColumn("size", F.col("size").cast("double")))
    with pytest.raises(Exception, match="0 or more"):
        dollar_bars(trades[1].withColumn("price", -F.col("price"))).collect()
