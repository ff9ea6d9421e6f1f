"""Queries p1 to p3 and p5 over ticks and bars, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import tidy_symbol
from tickloom.operators.anomalies import implausible_readings
from tickloom.operators.autoregression import HUBER, NORMAL_95, robust_autoregression
from tickloom.operators.grid import regular_grid
from tickloom.operators.rolling import build_tree, correct_saved_tree, latest_revision, save_tree, trailing_totals, update_tree
from tickloom.operators.salted import key_shares, salted_aggregate, salted_top
from tickloom.sources.tables import read_table, shared_dir

_SLOT = "yyyy-MM-dd HH:mm"


def _tidy(df: DataFrame) -> DataFrame:
    return df.withColumn("symbol", tidy_symbol("symbol"))


def _finite(price: str):
    p = F.col(price)
    return p.isNotNull() & ~F.isnan(p) & (p > 0) & (p < float("inf"))


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return key_shares(_tidy(read_table(spark, directory, "ticks").select("symbol")), "symbol", least=0.03).select("symbol")


def p1_symbol_totals(spark: SparkSession, directory: str) -> DataFrame:
    ticks = _tidy(read_table(spark, directory, "ticks").select("tick_id", "timestamp", "symbol", "price", "size")).distinct()
    good = _finite("price")
    price = F.when(good, F.col("price"))
    value = F.when(good & (F.col("size") >= 1), F.col("price") * F.col("size"))
    aggregates = {"n_ticks": ("count",), "last_price": ("last", F.when(F.col("timestamp").isNotNull(), price), "timestamp", "tick_id"), "traded_value": ("sum", value), "n_priced": ("count", price), "top_price": ("max", price)}
    out = salted_aggregate(ticks.where("symbol is not null"), ["symbol"], aggregates)
    return out.withColumn("traded_value", F.floor(F.col("traded_value") * 10 + 0.37) / 10)


def p1_symbol_profile(spark: SparkSession, directory: str) -> DataFrame:
    """Results for which a symbol's rows cannot be added up: different venues and middle price."""
    ticks = _tidy(read_table(spark, directory, "ticks").select("symbol", "price", "venue"))
    return salted_aggregate(ticks.where("symbol is not null"), ["symbol"], {"n_ticks": ("count",), "n_venues": ("distinct", "venue"), "middle_price": ("quantile", F.when(_finite("price"), F.col("price")), 0.5)})


def p1_latest(spark: SparkSession, directory: str) -> DataFrame:
    """The three latest trades of each symbol."""
    ticks = _tidy(read_table(spark, directory, "ticks").select("tick_id", "timestamp", "symbol").where("symbol is not null and timestamp is not null")).distinct()
    return salted_top(ticks, ["symbol"], [F.col("timestamp").desc(), F.col("tick_id").desc()], 3)


def _findings(spark: SparkSession, directory: str) -> DataFrame:
    ticks = _tidy(read_table(spark, directory, "ticks").select("tick_id", "timestamp", "symbol", "price", "size"))
    return implausible_readings(ticks)


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    found = _findings(spark, directory).where("kind <> 'shift'")
    return found.select(F.col("id").alias("tick_id"), "field").distinct()


def p2_findings(spark: SparkSession, directory: str) -> DataFrame:
    return _findings(spark, directory).select(F.col("id").alias("tick_id"), "field", "kind")


def p2_iterated(spark: SparkSession, directory: str) -> DataFrame:
    """Outliers and level shifts of the possible prices against a fitted autoregression, tested twice."""
    ticks = _tidy(read_table(spark, directory, "ticks").select("tick_id", "timestamp", "symbol", "price").where(_finite("price")))
    return robust_autoregression(ticks).select(F.col("id").alias("tick_id"), "kind", "pass")


def _readings(spark: SparkSession, directory: str) -> DataFrame:
    ticks = _tidy(read_table(spark, directory, "ticks").where(_finite("price"))).select(F.lit("ticks").alias("feed"), "symbol", F.col("timestamp").alias("at"), F.col("price").alias("value"))
    bars = _tidy(read_table(spark, directory, "bars")).select(F.lit("bars").alias("feed"), "symbol", F.col("ts_event_start").alias("at"), F.col("close").alias("value"))
    return ticks.unionByName(bars)


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    grid = regular_grid(_readings(spark, directory), ["feed", "symbol"], "at", "value", "30m", per_day=True)
    return grid.where(F.col("status").isin("interpolated", "gap")).select("feed", "symbol", F.date_format("slot_start", _SLOT).alias("slot_start"))


def p3_whole_days(spark: SparkSession, directory: str) -> DataFrame:
    """All half hours of each day with a reading, from midnight to midnight."""
    grid = regular_grid(_readings(spark, directory), ["feed", "symbol"], "at", "value", "30m", per_day=True, bounds="day")
    return grid.select("feed", "symbol", F.date_format("slot_start", _SLOT).alias("slot_start"), "status")


def p3_grid(spark: SparkSession, directory: str) -> DataFrame:
    grid = regular_grid(_readings(spark, directory), ["feed", "symbol"], "at", "value", "30m", per_day=True)
    return grid.select("feed", "symbol", F.date_format("slot_start", _SLOT).alias("slot_start"), (F.floor(F.col("value") * 1e6 + 0.37) / 1e6).alias("value"), "status")


def _measured(bars: DataFrame) -> tuple[DataFrame, dict]:
    close = F.col("close").isNotNull() & ~F.isnan("close")
    kept = bars.where("symbol is not null and ts_event_start is not null").withColumn("trade_day", F.to_date("ts_event_start"))
    return kept, {"volume": F.coalesce(F.col("volume"), F.lit(0)), "close_sum": F.when(close, F.col("close")).otherwise(0.0), "close_n": close.cast("long"), "bars_n": F.lit(1).cast("long")}


_BAR_COLUMNS = ["symbol", "ts_event_start", "close", "volume"]


def _tree(spark: SparkSession, directory: str) -> DataFrame:
    bars = _tidy(latest_revision(read_table(spark, directory, "bars"), "bar_id", "revision", _BAR_COLUMNS))
    kept, measures = _measured(bars)
    return build_tree(kept, ["symbol"], "trade_day", measures)


def _report(tree: DataFrame) -> DataFrame:
    # A day's leaf without any bar left (all corrected away) is no day with bars.
    live = tree.where("level > 0 or bars_n > 0")
    t = trailing_totals(live, ["symbol"], ["volume", "close_sum", "close_n", "bars_n"])
    mean = lambda s, n: F.floor(F.try_divide(F.col(s), F.col(n)) * 1e6 + 0.37) / 1e6
    return t.select("symbol", F.date_format("day", "yyyy-MM-dd").alias("trade_day"), "volume_7", "volume_30", *(mean(f"volume_{n}", f"bars_n_{n}").alias(f"volume_avg_{n}") for n in (7, 30)), *(mean(f"close_sum_{n}", f"close_n_{n}").alias(f"close_avg_{n}") for n in (7, 30)))


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return _report(_tree(spark, directory)).where("volume_7 = 0 and volume_30 > 0").select("symbol", "trade_day")


def p5_trailing(spark: SparkSession, directory: str) -> DataFrame:
    return _report(_tree(spark, directory))


_NAMES = ["volume", "close_sum", "close_n", "bars_n"]


def _deliveries(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """First deliveries, and what later ones change: the last deliveries less the first ones, as differences per symbol and day."""
    bars = read_table(spark, directory, "bars").where("bar_id is not null").select("bar_id", "revision", *_BAR_COLUMNS)
    order = ["revision", *_BAR_COLUMNS]
    place = lambda way: F.row_number().over(Window.partitionBy("bar_id").orderBy(*(way(F.col(c)) for c in order)))
    ends = _tidy(bars.withColumns({"first": place(lambda c: c.asc_nulls_first()) == 1, "last": place(lambda c: c.desc_nulls_last()) == 1}).where("first or last"))
    kept, measures = _measured(ends)
    sign = F.when(F.col("first"), -1).otherwise(1)
    changed = kept.where("first <> last").select("symbol", "trade_day", *((c * sign).alias(n) for n, c in measures.items()))
    return build_tree(kept.where("first"), ["symbol"], "trade_day", measures), changed


def p5_corrected(spark: SparkSession, directory: str) -> DataFrame:
    """As p5_trailing, from a tree of first deliveries that the later revisions correct."""
    tree, changed = _deliveries(spark, directory)
    return _report(update_tree(tree, changed, ["symbol"], "trade_day", _NAMES))


def p5_saved(spark: SparkSession, directory: str) -> DataFrame:
    """The same from a saved tree that is corrected in place."""
    tree, changed = _deliveries(spark, directory)
    path = f"{shared_dir(spark).rstrip('/')}/saved-{uuid.uuid4().hex}"
    save_tree(tree, path)
    correct_saved_tree(spark, path, changed, ["symbol"], "trade_day", _NAMES)
    return _report(spark.read.parquet(path).withColumn("shard", F.col("shard").cast("long")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p1_symbol_totals, p1_symbol_profile, p1_latest, p2_found, p2_findings, p2_iterated, p3_found, p3_grid, p3_whole_days, p5_found, p5_trailing, p5_corrected, p5_saved]
    return {f.__name__: f for f in own}


_SYM = "upper(trim(symbol))"
_GOOD = "(price is not null and not isnan(price) and not isinf(price) and price > 0)"

_P2 = f"""with t as (select distinct {_SYM} as s, tick_id, timestamp as ts, price, size from ticks where symbol is not null and timestamp is not null),
good as (select s, tick_id, ts, price, price - lag(price) over w as dp, median(price) over (w rows between 7 preceding and 1 preceding) as b, median(price) over (w rows between 1 following and 7 following) as a from t where {_GOOD} window w as (partition by s order by ts, tick_id)),
step as (select s, quantile_disc(abs(dp), 0.95) as step from good group by s having count(*) >= 60),
off as (select tick_id, coalesce(abs(price - b), abs(price - a)) > 6 * step * (1 + 1e-9) as off_b, coalesce(abs(price - a), abs(price - b)) > 6 * step * (1 + 1e-9) as off_a, a is not null and b is not null as two_sided from good join step using (s)),
middle as (select s, median(size) as m from t where size >= 1 group by s having count(*) >= 60),
vals as (select s, tick_id, ts, 'price' as field, price as v, {_GOOD} as ok from t where price is not null union all select s, tick_id, ts, 'size', size::double, size >= 1 from t where size is not null),
eq as (select *, coalesce(v = lag(v) over w and not isnan(v), false) as same from vals window w as (partition by s, field order by ts, tick_id)),
runs as (select *, sum(case when same then 0 else 1 end) over (partition by s, field order by ts, tick_id) as run from eq),
q as (select s, field, avg(same::int) as q from eq group by s, field having count(*) filter (ok) >= 60),
lens as (select s, field, run, count(*) as n from runs group by 1, 2, 3),
found as (select tick_id, field, 'limit' as kind from vals where not ok
union all select tick_id, 'price', 'spike' from off where off_a and off_b
union all select tick_id, 'price', 'shift' from off where off_b and not off_a and two_sided
union all select tick_id, 'size', 'spike' from t join middle using (s) where size > 20 * m
union all select tick_id, r.field, 'stuck' from runs r join lens l using (s, field, run) join q using (s, field) where same and power(q, n - 1) < 1e-9)"""

def _regression_pass(k: int, source: str) -> str:
    """CTEs of one pass of the autoregression of order 2, fitted twice, over the readings of ``source`` (s, ts, tick_id, x)."""
    past = ["1.0::double", "(l1 - m)", "(l2 - m)"]
    sums = ", ".join([f"sum(w * {past[i]} * {past[j]}) as a{i}{j}" for i in range(3) for j in range(i, 3)] + [f"sum(w * {past[i]} * (x - m)) as b{i}" for i in range(3)])
    det = lambda m: f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"
    a = ["a00", "a01", "a02", "a01", "a11", "a12", "a02", "a12", "a22"]
    put = lambda c: [f"b{i // 3}" if i % 3 == c else a[i] for i in range(9)]
    out = f"""n{k} as (select *, lag(x, 1) over w as l1, lag(x, 2) over w as l2, lead(x, 1) over w as f1, lead(x, 2) over w as f2 from {source} window w as (partition by s order by ts, tick_id)),
c{k}_0 as (select s, avg(x) as m, quantile_disc(abs(x - l1), 0.95) as step, 0.0::double as c0, 1.0::double as c1, 0.0::double as c2 from n{k} group by s having count(*) >= 60)"""
    for r in (1, 2):
        out += f""",
e{k}_{r} as (select *, (x - m) - c0 - c1 * (l1 - m) - c2 * (l2 - m) as e from n{k} join c{k}_{r - 1} using (s) where l2 is not null),
t{k}_{r} as (select s, m, step, c0, c1, c2, {sums} from (select *, case when abs(l1 - l2) > step * 6 then 0 when abs(e) <= step * {HUBER / NORMAL_95!r}::double then 1 else step * {HUBER / NORMAL_95!r}::double / abs(e) end as w from e{k}_{r}) group by s, m, step, c0, c1, c2),
c{k}_{r} as (select s, m, step, {", ".join(f"case when abs(d) > 1e-9 * a00 * a11 * a22 then {det(put(i))} / d else c{i} end as c{i}" for i in range(3))} from (select *, {det(a)} as d from t{k}_{r}))"""
    out += f""",
r{k} as (select *, (x - m) - c0 - c1 * (l1 - m) - c2 * (l2 - m) as e0, (f1 - m) - c0 - c1 * (x - m) - c2 * (l1 - m) as e1, (f2 - m) - c0 - c1 * (f1 - m) - c2 * (x - m) as e2 from n{k} join c{k}_2 using (s) where l2 is not null),
q{k} as (select s, quantile_disc(abs(e0), 0.95) as scale from r{k} group by s),
x{k} as (select *, abs(e0 + coalesce(-c1 * e1, 0) + coalesce(-c2 * e2, 0)) / sqrt(1 + case when e1 is null then 0 else c1 * c1 end + case when e2 is null then 0 else c2 * c2 end) as outlier,
  abs(e0 + coalesce((1 - c1) * e1, 0) + coalesce((1 - c1 - c2) * e2, 0)) / sqrt(1 + case when e1 is null then 0 else (1 - c1) ** 2 end + case when e2 is null then 0 else (1 - c1 - c2) ** 2 end) as shift from r{k} join q{k} using (s)),
y{k} as (select *, greatest(outlier, shift) as most, max(greatest(outlier, shift)) over (partition by s order by ts, tick_id rows between 2 preceding and 2 following) as other from x{k}),
h{k} as (select tick_id, s, case when outlier >= shift * (1 - 1e-9) then 'outlier' else 'shift' end as kind, {k} as pass from y{k} where most > scale * 6 * (1 + 1e-9) and most >= other * (1 - 1e-9))"""
    return out


_P2_ITERATED = f"""with t as (select distinct {_SYM} as s, timestamp as ts, tick_id, price as x from ticks where symbol is not null and timestamp is not null and {_GOOD}),
{_regression_pass(1, "t")},
t2 as (select * from t where not exists (select 1 from h1 where h1.tick_id = t.tick_id and kind = 'outlier')),
{_regression_pass(2, "t2")}
select tick_id, kind, pass from h1 union all select tick_id, kind, pass from h2"""

_P3 = f"""with r as (select distinct 'ticks' as feed, {_SYM} as symbol, timestamp as tm, price as v from ticks where symbol is not null and timestamp is not null and {_GOOD}
union select distinct 'bars', {_SYM}, ts_event_start, close from bars where symbol is not null and ts_event_start is not null and close is not null and not isnan(close)),
s as (select feed, symbol, time_bucket(interval 30 minutes, tm, timestamp '1970-01-01') as slot, arg_min(v, (tm, v)) as v0, min(tm) as t0, arg_max(v, (tm, v)) as v1, max(tm) as t1 from r group by 1, 2, 3),
p as (select *, lead(slot) over w as nx, lead(v0) over w as v2, lead(t0) over w as t2 from s window w as (partition by feed, symbol, slot::date order by slot)),
g as (select *, unnest(generate_series(slot, coalesce(nx - interval 30 minutes, slot), interval 30 minutes)) as tm from p)"""

_P5 = f"""with u as (select distinct bar_id, revision, {_SYM} as symbol, ts_event_start, close, volume from bars),
l as (select * from u qualify row_number() over (partition by bar_id order by revision desc) = 1),
k as (select symbol, ts_event_start::date as day, sum(coalesce(volume, 0)) as v, sum(close) as c, count(close) as n, count(*) as bars from l where symbol is not null and ts_event_start is not null group by 1, 2),
e as (select symbol, unnest(generate_series(min(day), max(day), interval 1 day))::date as day from k group by symbol),
w as (select e.symbol, e.day, sum(case when k.day > e.day - 7 then v end) as v7, sum(v) as v30, sum(case when k.day > e.day - 7 then c end) as c7, sum(c) as c30, sum(case when k.day > e.day - 7 then n end) as n7, sum(n) as n30, sum(case when k.day > e.day - 7 then bars end) as b7, sum(bars) as b30
 from e left join k on k.symbol = e.symbol and k.day <= e.day and k.day > e.day - 30 group by 1, 2)"""


def _round(x: str, digits: str = "1e6") -> str:
    return f"floor(({x}) * {digits} + 0.37) / {digits}"


def oracle_sql() -> dict[str, str]:
    line = "case when tm = slot then v1 else v1 + (v2 - v1) * (epoch_us(tm) - epoch_us(t1))::double / (epoch_us(t2) - epoch_us(t1)) end"
    missing = "(epoch_us(nx) - epoch_us(slot)) / 1800000000 - 1"
    trailing = f"""{_P5} select symbol, strftime(day, '%Y-%m-%d') as trade_day, coalesce(v7, 0)::bigint as volume_7, coalesce(v30, 0)::bigint as volume_30, {_round("v7 / nullif(b7, 0)")} as volume_avg_7, {_round("v30 / nullif(b30, 0)")} as volume_avg_30,
    {_round("c7 / nullif(n7, 0)")} as close_avg_7, {_round("c30 / nullif(n30, 0)")} as close_avg_30 from w"""
    return {
        "p1_found": f"select {_SYM} as symbol from ticks where symbol is not null group by 1 having count(*) >= 0.03 * (select count(*) from ticks)",
        "p1_symbol_totals": f"""with t as (select distinct tick_id, timestamp, {_SYM} as symbol, price, size from ticks where symbol is not null) select symbol, count(*)::bigint as n_ticks, arg_max(price, (timestamp, tick_id)) filter ({_GOOD} and timestamp is not null) as last_price,
        {_round(f"sum(price * size) filter ({_GOOD} and size >= 1)", "10")} as traded_value, count(*) filter ({_GOOD})::bigint as n_priced, max(price) filter ({_GOOD}) as top_price from t group by symbol""",
        "p1_symbol_profile": f"select {_SYM} as symbol, count(*)::bigint as n_ticks, count(distinct venue)::bigint as n_venues, quantile_disc(price, 0.5) filter ({_GOOD}) as middle_price from ticks where symbol is not null group by 1",
        "p1_latest": f"with t as (select distinct tick_id, timestamp, {_SYM} as symbol from ticks where symbol is not null and timestamp is not null) select tick_id, timestamp, symbol, row_number() over (partition by symbol order by timestamp desc, tick_id desc)::int as rank from t qualify rank <= 3",
        "p2_found": f"{_P2} select distinct tick_id, field from found where kind <> 'shift'",
        "p2_findings": f"{_P2} select tick_id, field, kind from found",
        "p2_iterated": _P2_ITERATED,
        "p3_found": f"{_P3} select feed, symbol, strftime(tm, '%Y-%m-%d %H:%M') as slot_start from g where tm <> slot",
        "p3_grid": f"{_P3} select feed, symbol, strftime(tm, '%Y-%m-%d %H:%M') as slot_start, {_round(f'case when tm = slot or {missing} <= 4 then {line} end')} as value, case when tm = slot then 'observed' when {missing} <= 4 then 'interpolated' else 'gap' end as status from g",
        "p3_whole_days": f"""{_P3}, b as (select feed, symbol, slot::date as day, min(slot) as lo, max(slot) as hi from s group by 1, 2, 3), a as (select *, unnest(generate_series(day::timestamp, day::timestamp + interval 1410 minutes, interval 30 minutes)) as tm from b)
        select a.feed, a.symbol, strftime(a.tm, '%Y-%m-%d %H:%M') as slot_start, case when a.tm < lo then 'leading' when a.tm > hi then 'trailing' when a.tm = g.slot then 'observed' when {missing} <= 4 then 'interpolated' else 'gap' end as status from a left join g on a.feed = g.feed and a.symbol = g.symbol and a.tm = g.tm""",
        "p5_found": f"{_P5} select symbol, strftime(day, '%Y-%m-%d') as trade_day from w where coalesce(v7, 0) = 0 and v30 > 0",
        "p5_trailing": trailing,
        "p5_corrected": trailing,
        "p5_saved": trailing,
    }
