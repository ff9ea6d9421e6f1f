"""Queries for the market-data transforms over the events table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.config import Config
from tickloom.functions.columns import parse_into_expr
from tickloom.operators import bars, dynamic_labels, frac_diff, labels
from tickloom.sources.tables import read_table
from tickloom.streaming.time_bars import streaming_time_bars

_NAMES = {"timestamp_column": "ts_event"}


def trades(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "events").select(F.col("event_type").alias("symbol"), F.col("ts").alias("ts_event"), F.col("value").alias("price"), (F.col("event_id") % 100 + 1).alias("size"), "event_id")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """To 6 decimals, away from halves: both engines then agree though their sums differ in the last bits."""
    return df.withColumns({n: F.floor(F.col(n) * 1e6 + 0.37) / 1e6 for n in names})


def _r(sql: str) -> str:
    return f"floor(({sql}) * 1e6 + 0.37) / 1e6"


def _bars(make: Callable[..., DataFrame], **options: object) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        with Config(**_NAMES):
            return _rounded(make(trades(spark, directory), tie_breakers=["event_id"], **options), "vwap")

    return run


def _volume_float(spark: SparkSession, directory: str) -> DataFrame:
    with Config(**_NAMES):
        t = trades(spark, directory).withColumn("size", F.col("size") / 4)
        return _rounded(bars.volume_bars(t, bar_size=512.25, tie_breakers=["event_id"]), "vwap")


def _groups(allow_splits: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        t = trades(spark, directory).withColumn("size", F.col("size") / 4)
        out = bars.bar_groups(t, "size", 512.25, allow_splits=allow_splits, partition_by=["symbol"], order_by=["ts_event", "event_id"])
        return out.select("event_id", "bar_group__id", "bar_group__amount")

    return run


def _lineitem_ticks(spark: SparkSession, directory: str) -> DataFrame:
    """Heavy ties: all times are midnights."""
    t = read_table(spark, directory, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts_event"), (F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price"), F.col("l_quantity").cast("bigint").alias("size"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    with Config(**_NAMES):
        return _rounded(bars.tick_bars(t, bar_size=50, tie_breakers=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]), "vwap", "open", "high", "low", "close")


def _fixed_return(spark: SparkSession, directory: str) -> DataFrame:
    return trades(spark, directory).select("event_id", labels.fixed_time_return("price", 5, symbol="symbol", order_by=["ts_event", "event_id"]).alias("ret"))


def _classify(threshold: object) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        limit = F.col("size") / 100 if threshold == "column" else threshold
        out = labels.add_fixed_time_return_classification(trades(spark, directory), "price", 5, limit, symbol="symbol", time="ts_event", tie_breakers=["event_id"])
        return out.select("event_id", "label")

    return run


def _classify_column_form(spark: SparkSession, directory: str) -> DataFrame:
    return trades(spark, directory).select("event_id", labels.fixed_time_return_classification("price", 5, 0.3, symbol="symbol", order_by=["ts_event", "event_id"]).alias("label"))


def _classify_all(spark: SparkSession, directory: str) -> DataFrame:
    """Without symbol: one series of all trades."""
    out = labels.add_fixed_time_return_classification(trades(spark, directory), "price", 5, 0.3, time="ts_event", tie_breakers=["event_id"], block=1_000)
    return out.select("event_id", "label")


def _streaming_bars(spark: SparkSession, directory: str) -> DataFrame:
    """The streaming operator over all trades at once, where nothing is late."""
    with Config(**_NAMES):
        return _rounded(streaming_time_bars(trades(spark, directory), bar_size="15m"), "vwap")


def _barrier(offset: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        with Config(**_NAMES):
            return dynamic_labels.get_vertical_barrier_by_timedelta(trades(spark, directory), offset)

    return run


def _daily_vol(spark: SparkSession, directory: str) -> DataFrame:
    with Config(**_NAMES):
        return _rounded(dynamic_labels.daily_vol(trades(spark, directory)), "daily_return_volatility")


def _frac_diff(spark: SparkSession, directory: str) -> DataFrame:
    return trades(spark, directory).select("event_id", frac_diff.frac_diff("price", 0.5, 1e-3, order_by=["ts_event", "event_id"], partition_by=["symbol"]).alias("fd")).transform(_rounded, "fd")


def _frac_diff_blocks(spark: SparkSession, directory: str) -> DataFrame:
    out = frac_diff.add_frac_diff(trades(spark, directory), "price", 0.5, 1e-3, out="fd", time="ts_event", tie_breakers=["event_id"], partition_by=["symbol"], block=500)
    return _rounded(out.select("event_id", "fd"), "fd")


def _return_blocks(spark: SparkSession, directory: str) -> DataFrame:
    out = labels.add_fixed_time_return(trades(spark, directory), "price", 5, symbol="symbol", out="ret", time="ts_event", tie_breakers=["event_id"], block=300)
    return out.select("event_id", "ret")


def _events(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    t = trades(spark, directory).where("price > 0")
    return dynamic_labels.get_vertical_barrier_by_timedelta(t, "6h").withColumn("target", F.lit(0.5)), t


def _triple(spark: SparkSession, directory: str) -> DataFrame:
    with Config(**_NAMES):
        events, t = _events(spark, directory)
        out = dynamic_labels.get_triple_barrier_label(events, t, "target", "vertical_barrier", 1.0, 1.0)
        return out.select("symbol", "ts_event", "touch_timestamp", F.col("return").alias("ret"), "label").transform(_rounded, "ret")


def _triple_open(spark: SparkSession, directory: str) -> DataFrame:
    """Every other event has no vertical barrier; wide horizontal ones; at the vertical barrier the sign of the return."""
    with Config(**_NAMES):
        events, t = _events(spark, directory)
        events = events.withColumn("vertical_barrier", F.when(F.minute("ts_event") % 2 == 0, F.col("vertical_barrier"))).withColumn("target", F.lit(4.0))
        out = dynamic_labels.get_triple_barrier_label(events, t, "target", "vertical_barrier", 2.0, 0.24, zero_at_vertical=False)
        return out.select("symbol", "ts_event", "touch_timestamp", F.col("return").alias("ret"), "label").transform(_rounded, "ret")


def _profit_stop(spark: SparkSession, directory: str) -> DataFrame:
    with Config(**_NAMES):
        events, t = _events(spark, directory)
        return dynamic_labels.apply_profit_taking_stop_loss(events, t, "target", "vertical_barrier", 3.0, 1.5).select("symbol", "ts_event", "vertical_barrier", "profit_take_touch", "stop_loss_touch")


def _coerced(spark: SparkSession, directory: str) -> DataFrame:
    return trades(spark, directory).select("event_id", parse_into_expr("price").alias("by_name"), parse_into_expr("price", str_as_lit=True).alias("by_text"), parse_into_expr(42, dtype="double").alias("number"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"time_bars_{n}": _bars(bars.time_bars, bar_size=n) for n in ("15m", "1h", "1d", "1w", "1mo")}
    for name, split in (("date", True), ("nodate", False)):
        out[f"tick_bars_{name}"] = _bars(bars.tick_bars, bar_size=20, split_by_date=split)
        out[f"volume_bars_{name}"] = _bars(bars.volume_bars, bar_size=2_000, split_by_date=split)
        out[f"dollar_bars_{name}"] = _bars(bars.dollar_bars, bar_size=5_000.0, split_by_date=split)
    return out | {
        "tick_bars_ties": _lineitem_ticks,
        "volume_bars_float": _volume_float,
        "bar_groups_split": _groups(True),
        "bar_groups_overflow": _groups(False),
        "fixed_time_return": _fixed_return,
        "classification_sign": _classify(None),
        "classification_threshold": _classify(0.3),
        "classification_column": _classify("column"),
        "classification_column_form": _classify_column_form,
        "classification_all": _classify_all,
        "streaming_time_bars_15m": _streaming_bars,
        "vertical_barrier_3h": _barrier("3h"),
        "vertical_barrier_1mo": _barrier("1mo"),
        "daily_vol_span100": _daily_vol,
        "frac_diff": _frac_diff,
        "frac_diff_blocks": _frac_diff_blocks,
        "fixed_time_return_blocks": _return_blocks,
        "triple_barrier": _triple,
        "triple_barrier_open": _triple_open,
        "profit_taking_stop_loss": _profit_stop,
        "parse_into_expr": _coerced,
    }


_T = "select event_type as symbol, ts as ts_event, value as price, event_id % 100 + 1 as size, event_id from events"
_AGG = f"""min(ts_event) as ts_event_start, max(ts_event) as ts_event_end, arg_min(price, (ts_event, event_id)) as open, max(price) as high,
min(price) as low, arg_max(price, (ts_event, event_id)) as close, {_r("sum(size * price) / sum(size)")} as vwap, sum(size)::bigint as volume, count(*)::bigint as n_trades"""
_OHLC = "ts_event_start, ts_event_end, open, high, low, close, vwap, volume, n_trades"


def _time_sql(bucket: str) -> str:
    return f"with t as ({_T}) select {bucket} as ts_event, symbol, {_AGG} from t where price is not null group by 1, 2"


def _tick_sql(split: bool) -> str:
    by = "symbol, d" if split else "symbol"
    return f"""with t as (select *, ts_event::date as d from ({_T}) where price is not null), n as (select *, (row_number() over (partition by {by} order by ts_event, event_id) - 1) // 20 as b from t)
    select symbol, {_OHLC} from (select symbol, b, {"d," if split else ""} {_AGG} from n group by {by}, b)"""


_QUARTERS = f"select symbol, ts_event, price, size / 4 as size, event_id from ({_T})"


def _pieces_sql(by: str) -> str:
    """Quarter sizes are exact as doubles, so running totals give what adding up in order does."""
    return f"""t as (select *, ts_event::date as d from ({_QUARTERS}) where price is not null and size > 0),
    c as (select *, sum(size) over (partition by {by} order by ts_event, event_id rows unbounded preceding) as hi from t),
    p as (select *, unnest(range(floor((hi - size) / 512.25)::bigint, (ceil(hi / 512.25))::bigint)) as b from c),
    q as (select * exclude (size), least(hi, (b + 1) * 512.25) - greatest(hi - size, b * 512.25) as size from p)"""


_OVERFLOW_SQL = f"""with recursive n as (select symbol, event_id, size::double as v, row_number() over (partition by symbol order by ts_event, event_id) as i from ({_QUARTERS})),
    scan as (select symbol, i, event_id, v, 0::bigint as g, case when v >= 512.25::double then 1 else 0 end::bigint as full, case when v >= 512.25::double then 0 else v end::double as s from n where i = 1
      union all
      select n.symbol, n.i, n.event_id, n.v, x.g + x.full, case when x.s + n.v >= 512.25::double then 1 else 0 end::bigint, case when x.s + n.v >= 512.25::double then 0 else x.s + n.v end::double from scan x join n on n.symbol = x.symbol and n.i = x.i + 1)
    select event_id, g as bar_group__id, v as bar_group__amount from scan"""


def _volume_sql(split: bool) -> str:
    by = "symbol, d" if split else "symbol"
    return f"""with t as (select *, ts_event::date as d from ({_T}) where price is not null and size > 0),
    c as (select *, (sum(size) over (partition by {by} order by ts_event, event_id rows unbounded preceding))::bigint as hi from t),
    p as (select *, unnest(range((hi - size) // 2000, (hi - 1) // 2000 + 1)) as b from c),
    q as (select * exclude (size), least(hi, (b + 1) * 2000) - greatest(hi - size, b * 2000) as size from p)
    select symbol, {_OHLC} from (select symbol, b, {"d," if split else ""} {_AGG} from q group by {by}, b)"""


def _dollar_sql(split: bool) -> str:
    part = "symbol, ts_event::date" if split else "symbol"
    b = "5000.0::double"
    return f"""with recursive n as (select *, dense_rank() over (order by {part}) as g, row_number() over (partition by {part} order by ts_event, event_id) as i from ({_T}) where price is not null and size > 0),
    s as (select g, i, price::double as p, size as n, 0::double as c0, 0::bigint as b0, ts_event, event_id, symbol from n where i = 1),
    scan as (
      select *, {_carry("c0", b)}, {_bars_closed("c0", b)} from s
      union all
      select n.g, n.i, n.price::double, n.size, x.c1, x.b0 + x.k1, n.ts_event, n.event_id, n.symbol, {_carry("x.c1", b, "n.price", "n.size")}, {_bars_closed("x.c1", b, "n.price", "n.size")}
      from scan x join n on n.g = x.g and n.i = x.i + 1),
    pieces as (select *, b0 + j as b, case when k1 = 0 then n when j = 0 then first_k when j < k1 then m else n - first_k - (k1 - 1) * m end as size
      from (select *, ceil({b} / nullif(p, 0))::bigint as m, least(n, greatest(1, ceil(({b} - c0) / nullif(p, 0))::bigint)) as first_k, unnest(range(0, k1 + 1)) as j from scan)),
    kept as (select g, symbol, ts_event, event_id, p as price, b, size from pieces where size > 0)
    select symbol, {_OHLC} from (select symbol, g, b, {_AGG} from kept group by symbol, g, b)"""


def _carry(c: str, b: str, p: str = "price", n: str = "size") -> str:
    p, n = ("p", "n") if p == "price" else (p, n)
    first = f"least({n}, greatest(1, ceil(({b} - {c}) / nullif({p}, 0))::bigint))"
    return f"case when {c} + {n} * {p} < {b} or not {p} > 0 then {c} + {n} * {p} else (({n} - {first}) % ceil({b} / {p})::bigint) * {p} end as c1"


def _bars_closed(c: str, b: str, p: str = "price", n: str = "size") -> str:
    p, n = ("p", "n") if p == "price" else (p, n)
    first = f"least({n}, greatest(1, ceil(({b} - {c}) / nullif({p}, 0))::bigint))"
    return f"case when {c} + {n} * {p} < {b} or not {p} > 0 then 0 else 1 + ({n} - {first}) // ceil({b} / {p})::bigint end::bigint as k1"


def _lead(k: int) -> str:
    return f"lead(price, {k}) over (partition by symbol order by ts_event, event_id)"


_RET = f"select *, {_lead(6)} / nullif({_lead(1)}, 0) - 1 as ret from ({_T})"


def _frac_sql() -> str:
    terms = frac_diff.frac_diff_weights(0.5, 1e-3)
    n = len(terms)
    total = " + ".join(f"lag(price, {n - 1 - i}) over w * ({w!r})::double" for i, w in enumerate(terms))
    return f"select event_id, {_r(total)} as fd from ({_T}) window w as (partition by symbol order by ts_event, event_id)"


def _paths_sql(barrier: str, up: float, down: float) -> str:
    return f"""with t as (select * from ({_T}) where price > 0), v as (select a.symbol, a.ts_event, a.price, b.ts_event as vb from t a asof left join t b on a.symbol = b.symbol and a.ts_event + interval 6 hour <= b.ts_event),
    e as (select symbol, ts_event, price, {barrier} as vb from v), f as (select e.*, coalesce(vb, last) as fin from e join (select symbol, max(ts_event) as last from t group by 1) using (symbol)),
    p as (select f.symbol, f.ts_event, f.vb, f.fin, t.ts_event as u, t.price / f.price - 1 as r from f join t on t.symbol = f.symbol and t.ts_event >= f.ts_event and t.ts_event <= f.fin),
    h as (select symbol, ts_event, any_value(vb) as vb, any_value(fin) as fin, min(u) filter (u > ts_event and r >= {up}) as up, min(u) filter (u > ts_event and r <= {down}) as down from p group by 1, 2)"""


def _triple_sql(barrier: str, up: float, down: float, at_end: str) -> str:
    return f"""{_paths_sql(barrier, up, down)} select h.symbol, h.ts_event, coalesce(least(up, down), h.fin) as touch_timestamp, {_r("p.r")} as ret, (case when least(up, down) is null then {at_end} else sign(p.r) end)::int as label
    from h join p on p.symbol = h.symbol and p.ts_event = h.ts_event and p.u = coalesce(least(h.up, h.down), h.fin)"""


def oracle_sql() -> dict[str, str]:
    out = {
        "time_bars_15m": _time_sql("time_bucket(interval 15 minutes, ts_event, timestamp '1970-01-01')"),
        "time_bars_1h": _time_sql("date_trunc('hour', ts_event)"),
        "time_bars_1d": _time_sql("date_trunc('day', ts_event)::timestamp"),
        "time_bars_1w": _time_sql("date_trunc('week', ts_event)::timestamp"),
        "time_bars_1mo": _time_sql("date_trunc('month', ts_event)::timestamp"),
    }
    for name, split in (("date", True), ("nodate", False)):
        out |= {f"tick_bars_{name}": _tick_sql(split), f"volume_bars_{name}": _volume_sql(split), f"dollar_bars_{name}": _dollar_sql(split)}
    lineitem = "select l_returnflag as symbol, l_shipdate::timestamp as ts_event, (l_extendedprice / l_quantity)::double as price, l_quantity::bigint as size, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem"
    out["volume_bars_float"] = f"with {_pieces_sql('symbol, d')} select symbol, {_OHLC} from (select symbol, b, d, {_AGG.replace('sum(size)::bigint', 'trunc(sum(size))::bigint')} from q group by symbol, d, b)"
    out |= {"bar_groups_split": f"with {_pieces_sql('symbol')} select event_id, b as bar_group__id, size::double as bar_group__amount from q", "bar_groups_overflow": _OVERFLOW_SQL}
    agg = _AGG.replace("(ts_event, event_id)", "i")
    out["tick_bars_ties"] = f"""with n as (select *, row_number() over (partition by symbol, ts_event order by ts_event, l_orderkey, l_linenumber, l_partkey, l_suppkey) as i from ({lineitem}) where price is not null)
    select symbol, ts_event_start, ts_event_end, {_r("open")} as open, {_r("high")} as high, {_r("low")} as low, {_r("close")} as close, vwap, volume, n_trades from (select symbol, {agg} from n group by symbol, ts_event, (i - 1) // 50)"""
    return out | {
        "fixed_time_return": f"select event_id, ret from ({_RET})",
        "classification_sign": f"select event_id, sign(ret)::int as label from ({_RET})",
        "classification_threshold": f"select event_id, (case when ret > 0.3 then 1 when ret < -0.3 then -1 when ret is not null then 0 end)::int as label from ({_RET})",
        "classification_column_form": f"select event_id, (case when ret > 0.3 then 1 when ret < -0.3 then -1 when ret is not null then 0 end)::int as label from ({_RET})",
        "classification_all": f"select event_id, (case when ret > 0.3 then 1 when ret < -0.3 then -1 when ret is not null then 0 end)::int as label from (select *, lead(price, 6) over w / nullif(lead(price, 1) over w, 0) - 1 as ret from ({_T}) window w as (order by ts_event, event_id))",
        "streaming_time_bars_15m": out["time_bars_15m"],
        "classification_column": f"select event_id, (case when ret > size / 100 then 1 when ret < -size / 100 then -1 when ret is not null then 0 end)::int as label from ({_RET})",
        "vertical_barrier_3h": f"with t as ({_T}) select a.ts_event, a.symbol, b.ts_event as vertical_barrier from t a asof left join t b on a.symbol = b.symbol and a.ts_event + interval 3 hour <= b.ts_event",
        "vertical_barrier_1mo": f"with t as ({_T}) select a.ts_event, a.symbol, b.ts_event as vertical_barrier from t a asof left join t b on a.symbol = b.symbol and a.ts_event + interval 1 month <= b.ts_event",
        "daily_vol_span100": f"""with t as ({_T}), r as (select a.symbol, a.ts_event, a.price / nullif(b.price, 0) - 1 as r, row_number() over (partition by a.symbol order by a.ts_event, a.event_id) as i
      from t a asof left join t b on a.symbol = b.symbol and a.ts_event - interval 1 day >= b.ts_event),
    p as (select a.symbol, a.ts_event, a.r as own, b.r, power(1 - 2.0 / 101, a.i - b.i) as w from r a join r b on a.symbol = b.symbol and b.i <= a.i and b.i > a.i - 2500 and b.r is not null),
    m as (select symbol, ts_event, any_value(own) as own, sum(w) as w, sum(w * w) as w2, sum(w * r) / sum(w) as m, count(*) as n from p group by symbol, ts_event),
    v as (select m.symbol, m.ts_event, any_value(m.own) as own, any_value(n) as n, sum(p.w * (p.r - m.m) ** 2) / any_value(m.w) * any_value(m.w) ** 2 / nullif(any_value(m.w) ** 2 - any_value(w2), 0) as var from m join p using (symbol, ts_event) group by m.symbol, m.ts_event)
    select r.symbol, r.ts_event, {_r("case when r.r is null then null when v.n = 1 then 0 else sqrt(v.var) end")} as daily_return_volatility from r left join v using (symbol, ts_event)""",
        "frac_diff": _frac_sql(),
        "frac_diff_blocks": _frac_sql(),
        "fixed_time_return_blocks": f"select event_id, ret from ({_RET})",
        "triple_barrier": _triple_sql("vb", 0.5, -0.5, "0"),
        "triple_barrier_open": _triple_sql("case when minute(ts_event) % 2 = 0 then vb end", 8.0, -0.96, "sign(p.r)"),
        "profit_taking_stop_loss": f"""{_paths_sql("vb", 1.5, -0.75)} select symbol, ts_event, vb as vertical_barrier, up as profit_take_touch, down as stop_loss_touch from h""",
        "parse_into_expr": f"select event_id, price as by_name, 'price' as by_text, 42::double as number from ({_T})",
    }


