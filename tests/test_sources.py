import datetime as dt

from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tickloom import Config, volume_bars
from tickloom.sources.ship import ship
from tickloom.sources.synthetic import generate_trade_data
from tickloom.sources.tables import input_bytes, partitions_for, shared_dir, stored


def test_generated_trades(spark):
    t = generate_trade_data(spark, 500, 4, seed=3)
    assert rows(t) == rows(generate_trade_data(spark, 500, 4, seed=3)) != rows(generate_trade_data(spark, 500, 4, seed=4))
    p = t.toPandas()
    assert p["symbol"].nunique() == 4 and p["price"].between(1, 100).all() and p["size"].between(10_000, 100_000).all()
    assert p["ts_event"].min() >= dt.datetime(2024, 1, 1) and p["ts_event"].max() < dt.datetime(2024, 1, 6)


def test_volume_bars_of_generated_trades(spark):
    """Against a unit-free pandas walk through the trades of each symbol."""
    t = generate_trade_data(spark, 120, 3).withColumn("tick", F.monotonically_increasing_id())
    with Config(timestamp_column="ts_event"):
        got = sorted((r.symbol, r.volume, r.n_trades, round(r.vwap, 9)) for r in volume_bars(t, bar_size=150_000, split_by_date=False).collect())
    want = []
    for sym, own in t.toPandas().sort_values(["ts_event", "price", "size"]).groupby("symbol"):
        bar: list[tuple[int, float]] = []
        for price, size in zip(own["price"], own["size"]):
            while size:
                take = min(size, 150_000 - sum(n for n, _ in bar))
                bar.append((take, price))
                size -= take
                if sum(n for n, _ in bar) == 150_000:
                    want.append((sym, bar))
                    bar = []
        if bar:
            want.append((sym, bar))
    assert got == sorted((s, sum(n for n, _ in b), len(b), round(sum(n * p for n, p in b) / sum(n for n, _ in b), 9)) for s, b in want)


def test_stored(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": [1, 2, 3], "b": ["x", None, "z"]}))
    assert rows(stored(df, "t")) == rows(df)


def test_no_local_folder_on_a_cluster():
    """Executors that share no folder would each keep a part: an error, not a loss."""

    def session(master, told, set_already):
        made = []
        folder = SimpleNamespace(isDefined=lambda: set_already or bool(made), get=lambda: made[0] if made else "hdfs://set")
        context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: folder)), master=master, setCheckpointDir=made.append)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: told))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(session(master, None, False))
        assert shared_dir(session(master, "hdfs://told", False)) == "hdfs://told"
        assert shared_dir(session(master, None, True)) == "hdfs://set"
    assert shared_dir(session("local[4]", None, False)).startswith("/")


def test_sizes(spark, tmp_path):
    spark.range(1_000).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert 0 < input_bytes(t) == input_bytes(t.where("id > 5").select("id")) and input_bytes(t.alias("a").join(t.alias("b"), "id")) == 2 * input_bytes(t)
    assert partitions_for(t) == 4 and partitions_for(spark.createDataFrame([(1,)], "a int")) == 4


def test_ship_once(spark):
    ship(spark)
    before = list(spark.sparkContext._python_includes)
    ship(spark)
    assert spark.sparkContext._python_includes == before and any(x.endswith(".zip") for x in before)
