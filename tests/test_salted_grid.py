import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tickloom.operators.grid import regular_grid
from tickloom.operators.salted import heavy_keys, key_shares, salted, salted_aggregate, salted_apply, salted_top

D = dt.datetime
T0 = D(2024, 1, 1, 9)


def s(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_salted_aggregate_against_plain(spark):
    r = random.Random(1)
    data = [(r.choice(["HOT"] * 8 + ["a", "b", None]), r.choice([None, float(r.randint(1, 9))]), r.randint(1, 50)) for _ in range(3_000)]
    df = spark.createDataFrame(data, "k string, x double, t int")
    out = salted_aggregate(df, ["k"], {"n": ("count",), "nx": ("count", "x"), "s": ("sum", "x"), "lo": ("min", "x"), "hi": ("max", "x"), "m": ("avg", "x"), "f": ("first", "x", "t"), "l": ("last", "x", "t")}, salts=5, heavy_share=0.2)
    want = {}
    for k in {d[0] for d in data}:
        own = [(x, t) for q, x, t in data if q == k]
        v = [(t, x) for x, t in own if x is not None]
        xs = [x for _, x in v]
        want[k] = (len(own), len(xs), sum(xs), min(xs), max(xs), pytest.approx(sum(xs) / len(xs)), min(v)[1], max(v)[1])
    assert {row[0]: tuple(row)[1:] for row in out.collect()} == want
    assert [x.k for x in heavy_keys(df, ["k"], 0.5).collect()] == ["HOT"]


def test_salted_plan_has_no_python_and_bounded_broadcast(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, x double")
    plan = salted_aggregate(df, ["k"], {"s": ("sum", "x")})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_salted_edges(spark):
    empty = spark.createDataFrame([], "k string, x double")
    assert salted_aggregate(empty, ["k"], {"n": ("count",)}).count() == 0 and key_shares(empty, "k", least=0.1).count() == 0
    df = spark.createDataFrame([(None, None, 1), (None, 2.0, 1), ("a", None, 2)], "k string, x double, __salt int")
    assert rows(salted_aggregate(df, ["k"], {"s": ("sum", "x"), "m": ("avg", "x")})) == [("a", None, None), (None, 2.0, 2.0)]
    with pytest.raises(ValueError):
        salted_aggregate(df, ["k"], {"s": ("median", "x")})
    with pytest.raises(ValueError):
        salted_aggregate(df, ["nope"], {"n": ("count",)})


def test_heavy_key_with_constant_input_is_spread(spark):
    """Rows that are equal in all columns get different salts, of even sizes; light keys get none."""
    df = spark.createDataFrame([("HOT", 1.0)] * 20_000 + [(f"k{i}", 1.0) for i in range(900)], "k string, x double")
    n = {r[0]: r[1] for r in salted(df, ["k"], 32, 0.1).where("k = 'HOT'").groupBy("__salt").count().collect()}
    assert len(n) == 32 and max(n.values()) < 1.3 * min(n.values())
    assert salted(df, ["k"], 32, 0.1).where("k <> 'HOT' and __salt <> 0").count() == 0
    behind = df.repartition(8, "x").join(spark.createDataFrame([("HOT", 5)], "k string, y int"), "k")
    assert rows(salted_aggregate(behind, ["k"], {"n": ("count",), "s": ("sum", "y")})) == [("HOT", 20_000, 100_000)]
    for bad in (0, 1e-6, 2):
        with pytest.raises(ValueError):
            salted_aggregate(df, ["k"], {"n": ("count",)}, heavy_share=bad)


def test_counts_read_the_rows_twice_at_most(spark, tmp_path):
    spark.createDataFrame([("a", 1)] * 9, "k string, x int").write.parquet(str(tmp_path / "t"))
    out = key_shares(spark.read.parquet(str(tmp_path / "t")), "k", least=0.5)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Reused" in plan or plan.count("Scan parquet") <= 2


def test_by_value_and_top(spark):
    r = random.Random(7)
    data = [(r.choice(["HOT"] * 8 + ["a", None]), r.choice([None, float("nan"), *(x / 4 for x in range(-40, 40))]), i) for i in range(2_000)]
    df = spark.createDataFrame(data, "k string, x double, i int").withColumn("value", F.lit("z"))
    out = {row.k: tuple(row)[1:] for row in salted_aggregate(df, ["k"], {"d": ("distinct", "x"), "q": ("quantile", "x", 0.9), "m": ("quantile", "x", 0.5), "n": ("count",)}, heavy_share=0.2).collect()}
    for k in {d[0] for d in data}:
        own = [d[1] for d in data if d[0] == k and d[1] is not None]
        good = sorted(x for x in own if x == x)
        assert out[k] == (len({str(x) for x in own}), good[-(-len(good) * 9 // 10) - 1], good[-(-len(good) // 2) - 1], sum(d[0] == k for d in data))
    top = salted_top(df, ["k"], [F.col("i").desc()], 2, heavy_share=0.2)
    want = {(k, rank + 1, i) for k in {d[0] for d in data} for rank, i in enumerate(sorted((d[2] for d in data if d[0] == k), reverse=True)[:2])}
    assert {(x.k, x["rank"], x.i) for x in top.collect()} == want
    none = spark.createDataFrame([("a", None, 1)], "k string, x double, i int")
    assert rows(salted_aggregate(none, ["k"], {"d": ("distinct", "x"), "q": ("quantile", "x", 0.5)})) == [("a", 0, None)]
    assert salted_aggregate(none.limit(0), ["k"], {"d": ("distinct", "x")}).count() == 0


def test_salted_apply_bounds_groups(spark):
    df = spark.createDataFrame([("HOT", float(i)) for i in range(5_000)] + [(None, 3.0), ("a", 4.0)], "k string, x double")

    def partial(g):
        return g.groupby("k", dropna=False).agg(n=("x", "size"), s=("x", "sum")).reset_index()

    def merge(g):
        return g.groupby("k", dropna=False).agg(parts=("n", "size"), most=("n", "max"), s=("s", "sum")).reset_index()

    out = {x.k: x for x in salted_apply(df, ["k"], partial, "k string, n long, s double", merge, "k string, parts long, most long, s double", rows_per_group=500).collect()}
    assert out["HOT"].parts == 10 and out["HOT"].most < 700 and out["HOT"].s == sum(range(5_000)) and out[None].s == 3.0


def test_key_shares(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2 + [(None,)] * 2, "k string")
    assert rows(key_shares(df, "k")) == [("a", 6, 0.6), ("b", 2, 0.2)]
    assert rows(key_shares(df, "k", least=0.6)) == [("a", 6, 0.6)]


GRID = "k string, t timestamp_ntz, v double, slot_start int"


def test_grid(spark):
    df = spark.createDataFrame([("a", s(0), 1.0, 0), ("a", s(100), 2.0, 0), ("a", s(100), 3.0, 0), ("a", s(3600 + 1800), 6.0, 0), ("a", s(8 * 3600), 9.0, 0), ("b", s(60), 5.0, 0), ("b", s(60), 5.0, 0), (None, s(0), 1.0, 0), ("a", None, 1.0, 0), ("a", s(5), None, 0), ("a", s(5), float("nan"), 0)], GRID)
    got = {(r.k, r.slot_start): (r.value, r.status) for r in regular_grid(df, ["k"], "t", "v", "30m", max_fill=3).collect()}
    a = {t: x for (k, t), x in got.items() if k == "a"}
    assert len(a) == 17 and a[s(0)] == (3.0, "observed")
    assert a[s(1800)] == (pytest.approx(3 + 3 * 1700 / 5300), "interpolated") and a[s(3600)][1] == "interpolated"
    assert a[s(7200)] == (None, "gap") and a[s(8 * 3600)] == (9.0, "observed")
    assert {t: x for (k, t), x in got.items() if k == "b"} == {s(0): (5.0, "observed")}


def test_grid_bounds(spark):
    df = spark.createDataFrame([("a", s(0), 1.0, 0), ("a", s(86_400 + 60), 2.0, 0)], GRID)
    days = regular_grid(df, ["k"], "t", "v", "6h", per_day=True, bounds="day").collect()
    assert Counter(r.status for r in days) == {"observed": 2, "leading": 2, "trailing": 4}
    assert sorted(r.slot_start for r in days) == [D(2024, 1, d, h) for d in (1, 2) for h in (0, 6, 12, 18)]
    fixed = {r.slot_start: (r.value, r.status) for r in regular_grid(df, ["k"], "t", "v", "1d", bounds=(D(2023, 12, 31), D(2024, 1, 3, 5))).collect()}
    assert fixed == {D(2023, 12, 31): (None, "leading"), D(2024, 1, 1): (1.0, "observed"), D(2024, 1, 2): (2.0, "observed"), D(2024, 1, 3): (2.0, "trailing")}
    assert regular_grid(spark.createDataFrame([], GRID), ["k"], "t", "v", "1h").count() == 0
    for bad in ({"step": "1mo"}, {"step": "0s"}, {"step": "1h", "bounds": "day"}):
        with pytest.raises(ValueError):
            regular_grid(df, ["k"], "t", "v", **bad)


def test_grid_against_brute_force(spark):
    r = random.Random(4)
    data = [(r.choice("ab"), s(r.randint(0, 200_000)), float(r.randint(1, 99)), 0) for _ in range(150)]
    got = {(x.k, x.slot_start): (x.status) for x in regular_grid(spark.createDataFrame(data, GRID), ["k"], "t", "v", "30m", per_day=True).collect()}
    want = {}
    slot = lambda t: t.replace(minute=t.minute // 30 * 30, second=0)
    by = defaultdict(set)
    for k, t, *_ in data:
        by[k, t.date()].add(slot(t))
    for (k, _), slots in by.items():
        t = min(slots)
        while t <= max(slots):
            want[k, t] = t in slots
            t += dt.timedelta(minutes=30)
    assert {k: v == "observed" for k, v in got.items()} == want


def test_long_gaps_are_cut(spark):
    """A gap of many stretches comes out slot by slot, none twice."""
    df = spark.createDataFrame([("a", s(0), 1.0, 0), ("a", s(20_000), 2.0, 0)], GRID)
    out = regular_grid(df, ["k"], "t", "v", "1s", max_fill=20_000)
    assert out.count() == out.select("slot_start").distinct().count() == 20_001
    assert out.where(F.abs(F.col("value") - 1 - (F.unix_timestamp(F.col("slot_start").cast("timestamp")) - s(0).replace(tzinfo=dt.timezone.utc).timestamp()) / 20_000) > 1e-9).count() == 0
