"""Daily volatility, vertical barriers, profit-taking and stop-loss touches, triple-barrier labels.

The as-of lookups are windows over observations and questions merged on one time axis, so no self-join is planned.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.config import column_names
from tickloom.functions.columns import col, require
from tickloom.functions.durations import DAY_US, from_micros, parse_duration, shifted, to_micros
from tickloom.operators.blocks import HOUR_US, asof, ewm_std, solid
from tickloom.operators.salted import heavy_keys
from tickloom.sources.ship import ship
from tickloom.sources.tables import partitions_for, stored


def daily_vol(df: DataFrame, *, span: int = 100, tie_breakers: Sequence[str] = ()) -> DataFrame:
    """Exponentially weighted standard deviation of the return over 24 hours, one output row per input row.

    The earlier price is the last one at or before 24 hours ago, of the same symbol if there is such a column. The first return's
    deviation is 0.0; rows without a return are null. Columns out: timestamp[, symbol], daily_return_volatility.
    Null timestamps never find an earlier price. Empty input gives an empty frame; further columns are dropped.
    """
    ts, sym, price = column_names.timestamp, column_names.symbol, column_names.price
    require(df, ts, price, *tie_breakers)
    keys = [sym] if sym in df.columns else []
    p = col(price).cast("double")
    key = solid(col(sym)) if keys else F.lit("")
    kept = [col(ts).alias("t"), *(col(k).alias("sym") for k in keys)]
    rows = df.select(*kept, key.alias("k"), to_micros(col(ts)).alias("us"), F.struct(*(col(c).alias(f"o{i}") for i, c in enumerate(tie_breakers)), p.alias("p")).alias("tie"), F.struct(p.alias("p")).alias("value"))
    found = asof(rows, DAY_US, forward=False)
    moved = found.withColumn("r", F.try_divide(F.col("value.p"), F.col("found.p")) - 1)
    out = ewm_std(moved, "k", ["us", "tie"], "r", span, ["t", *(["sym"] if keys else [])], "v")
    return out.select(F.col("t").alias(ts), *([F.col("sym").alias(sym)] if keys else []), F.col("v").alias("daily_return_volatility"))


def get_vertical_barrier_by_timedelta(df: DataFrame, offset: str | dt.timedelta) -> DataFrame:
    """First observation at or after timestamp + offset, of the same symbol if there is such a column; null when none.

    Columns out: timestamp[, symbol], vertical_barrier. Observations and shifted times, also by calendar months, meet in time buckets,
    so a busy symbol, or all rows where there is none, are spread over the buckets.
    """
    ts, sym = column_names.timestamp, column_names.symbol
    require(df, ts)
    by = parse_duration(offset)
    keys = [sym] if sym in df.columns else []
    key = solid(col(sym)) if keys else F.lit("")
    rows = df.select(col(ts).alias("t"), *(col(k).alias("sym") for k in keys), key.alias("k"), to_micros(col(ts)).alias("us"), F.lit(0).alias("tie"), col(ts).alias("value"))
    # The length of a calendar offset differs from row to row; it is never shorter than 28 days a month.
    asked = None if not by.months else to_micros(shifted(F.col("t"), by))
    found = asof(rows, by.micros + by.months * 28 * DAY_US, forward=True, asked=asked)
    return found.select(F.col("t").alias(ts), *([F.col("sym").alias(sym)] if keys else []), F.col("found").alias("vertical_barrier"))


BUCKET_US = HOUR_US
_EVENT = ["k", "us", "barrier", "target"]
_EVENT_SQL = "k string, us long, barrier long, target double"
_ROWS_PER_GROUP = 200_000


def first_at_least(values: np.ndarray, level: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """First position in [lo, hi) whose value is at least level, hi where there is none: descent over doubling maxima, all questions
    at once."""
    tables = [values]
    while (1 << len(tables)) <= len(values):
        t, half = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.maximum(t[:-half], t[half:]))
    at = lo.copy()
    for k in range(len(tables) - 1, -1, -1):
        fits = at + (1 << k) <= hi
        skip = np.zeros(len(at), dtype=bool)
        skip[fits] = tables[k][at[fits]] < level[fits]
        at[skip] += 1 << k
    return at


def price_level(start: np.ndarray, ret: np.ndarray, up: bool) -> np.ndarray:
    """The lowest (highest) price whose return from start, as it is computed, reaches ret: exact to the last bit. Where no return can
    be told (null, start not above 0), a level that is never reached."""
    away = np.inf if up else -np.inf
    out = np.full(len(start), away)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        at = start * (1 + ret)
        for _ in range(3):
            at = np.nextafter(at, away)
        for _ in range(7):
            reached = (at / start - 1 >= ret) if up else (at / start - 1 <= ret)
            out = np.where(reached & (start > 0) & np.isfinite(at), at, out)
            at = np.nextafter(at, -away)
    return out


def _grouped(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray] | None:
    """A partition's rows, sorted by (k, b, side), as rows of side 0 and of side 1 and the numbers of their groups (k, b)."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return None
    t = pa.Table.from_batches(batches).combine_chunks()
    codes = t["k"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    b, side = t["b"].to_numpy(), t["side"].to_numpy()
    group = np.concatenate([[0], np.cumsum((codes[1:] != codes[:-1]) | (b[1:] != b[:-1]))])
    return t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1)), group[side == 0], group[side == 1]


def _place(group: np.ndarray, value: np.ndarray, lowest: int, asked_group: np.ndarray, asked: np.ndarray, side: str) -> np.ndarray:
    """np.searchsorted of the asked values within their groups, all at once; below its group's values a question gets its start."""
    span = np.int64(1) << np.int64(42)
    within = np.clip(asked - lowest + 1, 0, span - 1)
    return np.searchsorted(group * span + (value - lowest + 1), asked_group * span + within, side=side)


def _numbers(t: pa.Table, name: str, none: float) -> np.ndarray:
    return t[name].combine_chunks().fill_null(none).to_numpy(zero_copy_only=False)


def _masked(values: np.ndarray, have: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(np.where(have, values, 0), type=kind, mask=~have)


_ASKED_SQL = f"{_EVENT_SQL}, p0 double, up double, down double, b long, since long, until long, role string"
_FOUND = "p0 double, up_us long, up_p double, down_us long, down_p double, last_us long, last_p double"
_MAX, _MIN = 2**62, -(2**62)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first touches and the last price of each question in its bucket, after ``since`` and up to ``until``."""
    if (parts := _grouped(batches)) is None:
        return
    seen, asked, group, asked_group = parts
    if not len(asked):
        return
    u, p = seen["pu"].to_numpy(), seen["pp"].to_numpy()
    us = asked["us"].to_numpy()
    since, until = _numbers(asked, "since", _MIN), _numbers(asked, "until", _MAX)
    b = asked["b"].to_numpy()
    begin = b * BUCKET_US
    # Times are placed relative to their buckets, so that groups and times fit one number.
    rel = u - seen["b"].to_numpy() * BUCKET_US
    lo = _place(group, rel, 0, asked_group, np.maximum(since, begin - 1) - begin, "right")
    hi = np.maximum(lo, _place(group, rel, 0, asked_group, np.minimum(until, begin + BUCKET_US - 1) - begin, "right"))
    own = since == us
    before = np.maximum(lo - 1, 0)
    at_own = own & (lo > 0) & (len(u) > 0)
    if len(u):
        at_own &= (u[before] == us) & (group[before] == asked_group)
        p0 = np.where(own, np.where(at_own, p[before], np.nan), _numbers(asked, "p0", np.nan))
    else:
        p0 = np.where(own, np.nan, _numbers(asked, "p0", np.nan))
    up = first_at_least(p, price_level(p0, _numbers(asked, "up", np.nan), True), lo, hi)
    down = first_at_least(-p, -price_level(p0, _numbers(asked, "down", np.nan), False), lo, hi)
    cols = [*(asked[c].combine_chunks() for c in _EVENT), asked["role"].combine_chunks(), _masked(p0, ~np.isnan(p0), pa.float64())]
    from_own = np.where(at_own, lo - 1, lo)  # the last price may be that of the event's own time
    for at, hit in ((up, up < hi), (down, down < hi), (np.maximum(hi - 1, 0), hi > from_own)):
        safe = np.minimum(at, max(0, len(u) - 1))
        none = np.zeros(len(at))
        cols += [_masked(u[safe] if len(u) else none, hit, pa.int64()), _masked(p[safe] if len(u) else none, hit, pa.float64())]
    yield pa.RecordBatch.from_arrays(cols, names=[*_EVENT, "role", *(x.split()[0] for x in _FOUND.split(", "))])


def _far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For events that go on after their first bucket: the first later bucket whose highest (lowest) price reaches a barrier, the
    bucket of the end, and the last price of the buckets before it. A null end is the last observation."""
    if (parts := _grouped(batches)) is None:
        return
    seen, asked, group, asked_group = parts
    if not len(asked):
        return
    b, high, low, last_us, last_p = (seen[c].to_numpy() for c in ("bucket", "high", "low", "last_us", "last_p"))
    first = asked["first"].to_numpy()
    floor = int(b.min()) if len(b) else 0
    lo = _place(group, b, floor, asked_group, first, "right")
    after = np.searchsorted(group, asked_group, side="right")
    until = np.where(asked["until"].combine_chunks().is_null().to_numpy(zero_copy_only=False), last_us[np.maximum(after - 1, 0)] if len(b) else 0, _numbers(asked, "until", 0))
    final = until // BUCKET_US
    hi = np.maximum(lo, _place(group, b, floor, asked_group, final, "right"))
    p0 = _numbers(asked, "p0", np.nan)
    up = first_at_least(high, price_level(p0, _numbers(asked, "up", np.nan), True), lo, hi)
    down = first_at_least(-low, -price_level(p0, _numbers(asked, "down", np.nan), False), lo, hi)
    whole = np.maximum(lo, _place(group, b, floor, asked_group, final - 1, "right"))  # buckets that end before the end's own
    bucket = b if len(b) else np.zeros(1, dtype="int64")
    at = lambda i: np.minimum(i, len(bucket) - 1)
    cols = [*(asked[c].combine_chunks() for c in [*_EVENT, "p0", "up", "down"]), pa.array(until)]
    for i, hit in ((up, up < hi), (down, down < hi)):
        cols.append(_masked(bucket[at(i)], hit, pa.int64()))
    cols.append(pa.array(final))
    hit, i = whole > lo, at(np.maximum(whole - 1, 0))
    cols += [_masked(last_us[i] if len(b) else hit, hit, pa.int64()), _masked(last_p[i] if len(b) else hit, hit, pa.float64())]
    yield pa.RecordBatch.from_arrays(cols, names=[*_EVENT, "p0", "up", "down", "until", "up_b", "down_b", "final", "carried_us", "carried_p"])


def _together(seen: DataFrame, asked: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows of both sides, those of a group in one partition and in order; columns that a side lacks are null."""
    both = seen.withColumn("side", F.lit(0)).unionByName(asked.withColumn("side", F.lit(1)), allowMissingColumns=True)
    return both.repartition(partitions_for(seen), *by).sortWithinPartitions(*by, "side", *order)


def _paths(events: DataFrame, prices: DataFrame, profit_take: float | None, stop_loss: float | None, by_symbol: bool) -> DataFrame:
    """First touch of each barrier per event (k, us, barrier, target), and its end.

    Prices stand in (symbol, hour) buckets with their highest, lowest and last price. An event searches the bucket of its own time;
    one that goes on from there asks the table of bucket extremes, a row per bucket, for the first later bucket that reaches a
    barrier, and searches that one only. So an event is never copied along its path, however far its end. Events of a symbol with
    very many are spread over groups that each get the symbol's extremes.
    """
    ts, sym, price = column_names.timestamp, column_names.symbol, column_names.price
    ship(events.sparkSession)
    bucket = lambda us: ((us - F.pmod(us, F.lit(BUCKET_US))) / F.lit(BUCKET_US)).cast("long")
    p = col(price).cast("double")
    obs = prices.where(p.isNotNull() & ~F.isnan(p) & col(ts).isNotNull()).select((solid(col(sym)) if by_symbol else F.lit("")).alias("k"), to_micros(col(ts)).alias("pu"), p.alias("pp"))
    obs = obs.withColumn("b", bucket(F.col("pu")))
    never = F.lit(None).cast("double")
    up = F.col("target") * F.lit(profit_take) if profit_take is not None else never
    down = F.col("target") * F.lit(-stop_loss) if stop_loss is not None else never
    asked = events.where("us is not null").select(*_EVENT, never.alias("p0"), up.alias("up"), down.alias("down"), bucket(F.col("us")).alias("b"), F.col("us").alias("since"), F.col("barrier").alias("until"), F.lit("own").alias("role"))
    schema = f"{_EVENT_SQL}, role string, {_FOUND}"
    search = lambda q: _together(obs, q, ["k", "b"], ["pu", "pp"]).mapInArrow(_search, schema)
    own = stored(search(asked).where("p0 is not null"), "touches")
    on = own.withColumns({"up": up, "down": down, "first": bucket(F.col("us"))}).where("(up_us is null or down_us is null) and (barrier is null or barrier > us)").where(F.col("barrier").isNull() | (bucket(F.col("barrier")) > F.col("first")))
    # A barrier that is touched in the first bucket is not looked for again.
    on = on.select(*_EVENT, "p0", F.when(F.col("up_us").isNull(), F.col("up")).alias("up"), F.when(F.col("down_us").isNull(), F.col("down")).alias("down"), F.col("barrier").alias("until"), "first")
    hot = heavy_keys(on.select("k"), ["k"], 0.01).select(F.col("k").alias("__k"), F.ceil(F.col("n_rows") / _ROWS_PER_GROUP).cast("long").alias("__n"))
    spread = on.join(F.broadcast(hot), F.col("k") == F.col("__k"), "left").withColumn("b", F.coalesce(F.pmod(F.xxhash64(*_EVENT), F.col("__n")), F.lit(0))).drop("__k", "__n")
    extremes = obs.groupBy("k", F.col("b").alias("bucket")).agg(F.max("pp").alias("high"), F.min("pp").alias("low"), F.max(F.struct("pu", "pp")).alias("l")).select("k", "bucket", "high", "low", F.col("l.pu").alias("last_us"), F.col("l.pp").alias("last_p"))
    extremes = extremes.join(F.broadcast(hot), F.col("k") == F.col("__k"), "left").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__n", F.lit(1)) - 1))).drop("__k", "__n")
    far_schema = f"{_EVENT_SQL}, p0 double, up double, down double, until long, up_b long, down_b long, final long, carried_us long, carried_p double"
    far = stored(_together(extremes, spread, ["k", "b"], ["bucket"]).mapInArrow(_far, far_schema), "paths")
    roles = F.array(*(F.struct(F.lit(r).alias("role"), F.col(c).alias("b")) for r, c in (("up", "up_b"), ("down", "down_b"), ("last", "final"))))
    later = far.withColumn("x", F.explode(roles)).where("x.b is not null").select(*_EVENT, "p0", F.when(F.col("x.role") == "up", F.col("up")).alias("up"), F.when(F.col("x.role") == "down", F.col("down")).alias("down"), "x.b", F.lit(_MIN).alias("since"), "until", "x.role")
    found = search(later).where("up_us is not null or down_us is not null or role = 'last'")
    carried = far.select(*_EVENT, F.lit("carried").alias("role"), "p0", *(F.lit(None).cast(t).alias(c) for c, t in (("up_us", "long"), ("up_p", "double"), ("down_us", "long"), ("down_p", "double"))), F.col("carried_us").alias("last_us"), F.col("carried_p").alias("last_p"))
    ret = lambda x: F.try_divide(F.col(x), F.col("p0")) - 1
    parts = own.unionByName(found).unionByName(carried)
    best = parts.groupBy(*_EVENT).agg(F.min(F.when(F.col("up_us").isNotNull(), F.struct("up_us", ret("up_p").alias("r")))).alias("u"), F.min(F.when(F.col("down_us").isNotNull(), F.struct("down_us", ret("down_p").alias("r")))).alias("d"), F.max(F.when(F.col("last_us").isNotNull(), F.struct("last_us", ret("last_p").alias("r")))).alias("l"))
    first = F.least("u.up_us", "d.down_us")
    return best.select(*(F.col(c).alias(f"__{c}") for c in _EVENT), F.col("u.up_us").alias("__up"), F.col("d.down_us").alias("__down"), first.alias("__at"), F.when(F.col("u.up_us") == first, F.col("u.r")).when(first.isNotNull(), F.col("d.r")).otherwise(F.col("l.r")).alias("return"), F.coalesce(F.col("barrier"), F.col("l.last_us")).alias("__end"))


def apply_profit_taking_stop_loss(df: DataFrame, prices: DataFrame, target_col: str, vertical_barrier_col: str, profit_take: float | None = None, stop_loss: float | None = None) -> DataFrame:
    """First times after each event at which the return reaches ``target * profit_take`` or falls to ``-target * stop_loss``.

    Adds ``profit_take_touch``, ``stop_loss_touch`` (null when not reached up to the vertical barrier; a null barrier means the
    symbol's last observation). Events need a price at their own timestamp, the largest if there are several; without one all
    touches are null. Null and NaN prices are left out; rows with null times come out with nulls. Some of the jobs run when the
    function is called.
    """
    return _touches(df, prices, target_col, vertical_barrier_col, profit_take, stop_loss).drop("touch_timestamp", "return", "__first")


def _touches(df, prices, target_col, vertical_barrier_col, profit_take, stop_loss) -> DataFrame:
    ts, sym, price = column_names.timestamp, column_names.symbol, column_names.price
    require(df, ts, target_col, vertical_barrier_col)
    require(prices, ts, price)
    both = sym in df.columns and sym in prices.columns
    # An event is its symbol, time, barrier and target; equal events get equal answers.
    own = {"k": solid(col(sym)) if both else F.lit(""), "us": to_micros(col(ts)), "barrier": to_micros(col(vertical_barrier_col)), "target": col(target_col).cast("double")}
    events = df.select(*(c.alias(n) for n, c in own.items())).distinct()
    found = _paths(events, prices, profit_take, stop_loss, both)
    on = F.lit(True)
    for n, c in own.items():
        on = on & (c == F.col(f"__{n}") if n in ("k", "us") else c.eqNullSafe(F.col(f"__{n}")))
    end = F.when(F.col("__k").isNotNull(), F.coalesce("__at", "__end")).otherwise(to_micros(col(vertical_barrier_col)))
    out = df.join(found, on, "left").withColumns({"profit_take_touch": from_micros(F.col("__up")), "stop_loss_touch": from_micros(F.col("__down")), "touch_timestamp": from_micros(end), "__first": F.col("__at").isNotNull()})
    return out.select(*(col(c) for c in df.columns), "profit_take_touch", "stop_loss_touch", "touch_timestamp", "return", "__first")


def get_triple_barrier_label(df: DataFrame, prices: DataFrame, target_col: str, vertical_barrier_col: str, profit_take: float | None = None, stop_loss: float | None = None, *, zero_at_vertical: bool = True) -> DataFrame:
    """timestamp[, symbol], touch_timestamp, return and label: 1 or -1 by the horizontal barrier touched first; at the vertical
    barrier 0, or the sign of the return if ``zero_at_vertical`` is off. Null where the event has no price."""
    ts, sym = column_names.timestamp, column_names.symbol
    t = _touches(df, prices, target_col, vertical_barrier_col, profit_take, stop_loss)
    sign = F.signum("return").cast("int")
    label = F.when(F.col("return").isNull(), F.lit(None)).when(F.col("__first"), sign).otherwise(F.lit(0) if zero_at_vertical else sign).cast("int")
    keys = [col(sym)] if sym in df.columns else []
    return t.select(col(ts), *keys, "touch_timestamp", "return", label.alias("label"))


