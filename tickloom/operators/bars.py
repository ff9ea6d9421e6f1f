"""Trades to OHLCV bars by time, trade count, volume or value.

Common rules: rows with a null price are dropped, NaN prices stay (high and low pass over them), sizes may be null in time and
tick bars and count as a trade of no volume. Rows at equal times are ordered by ``tie_breakers`` (price, size unless given).
Empty input gives an empty frame; columns other than the four used are ignored. A null symbol is a group of its own. Missing
columns raise ValueError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, LongType, StructField, StructType, TimestampNTZType, TimestampType

from tickloom.config import column_names
from tickloom.functions.columns import INTEGRAL, NUMERIC, col, fresh, require, require_type
from tickloom.functions.durations import DAY_US, bucket_start, parse_duration, to_micros
from tickloom.operators.blocks import bucket_width, running_totals, solid, time_bucket
from tickloom.sources.ship import ship

_ORDER = "__order"
_CUT = "|"  # between day and symbol; a day has none


def _ohlcv() -> list[Column]:
    """Aggregates over the normalised columns of _trades()."""
    t, p, s, o = F.col("__t"), F.col("__p"), F.col("__s"), F.col(_ORDER)
    number = F.when(~F.isnan(p), p)
    ts = column_names.timestamp
    return [
        F.min(t).alias(f"{ts}_start"),
        F.max(t).alias(f"{ts}_end"),
        F.min_by(p, o).alias("open"),
        F.coalesce(F.max(number), F.lit(float("nan"))).alias("high"),
        F.coalesce(F.min(number), F.lit(float("nan"))).alias("low"),
        F.max_by(p, o).alias("close"),
        F.try_divide(F.sum(s * p), F.sum(s)).alias("vwap"),
        F.coalesce(F.sum(s), F.lit(0)).cast("long").alias("volume"),
        F.count(F.lit(1)).alias("n_trades"),
    ]


def _trades(df: DataFrame, tie_breakers: Sequence[str] | None, positive_size: bool = False) -> DataFrame:
    """Columns __sym, __t, __p, __s and the order key; only these reach the scan."""
    ts, sym, price, size = (getattr(column_names, n) for n in ("timestamp", "symbol", "price", "size"))
    require(df, ts, sym, price, size, *(tie_breakers or ()))
    require_type(df, price, NUMERIC, "numeric")
    require_type(df, size, NUMERIC, "numeric")
    kept = df.where(col(price).isNotNull() & (col(size) > 0) if positive_size else col(price).isNotNull())
    ties = [col(c) for c in (tie_breakers if tie_breakers is not None else (price, size))]
    return kept.select(
        col(sym).cast("string").alias("__sym"),
        col(ts).cast("timestamp_ntz").alias("__t"),
        col(price).cast("double").alias("__p"),
        col(size).alias("__s"),
        F.struct(col(ts), *ties).alias(_ORDER),
    )


def _result(df: DataFrame, leading: Sequence[Column] = (), sort: bool = False) -> DataFrame:
    ts, sym = column_names.timestamp, column_names.symbol
    out = df.select(*leading, F.col("__sym").alias(sym), *(col(c) for c in (f"{ts}_start", f"{ts}_end", "open", "high", "low", "close", "vwap", "volume", "n_trades")))
    return out.orderBy(col(f"{ts}_end"), col(sym), col(f"{ts}_start")) if sort else out


def _running(trades: DataFrame, split_by_date: bool, amount: Column) -> DataFrame:
    """Trades with the running total ``__hi`` of amount per symbol[, day] and the keys __key, __day that are never null."""
    us = to_micros(F.col("__t"))
    day = time_bucket(us, DAY_US) if split_by_date else F.lit(0).cast("long")
    keyed = trades.withColumns({"__key": solid(F.col("__sym")), "__day": day, "__hour": time_bucket(us, bucket_width(trades))})
    return running_totals(keyed, ["__key", "__day"], "__hour", _ORDER, amount, "__hi")


def _symbol() -> Column:
    return F.when(F.col("__key") != "", F.expr("substring(__key, 2)"))


def _check_size(bar_size: float) -> None:
    if not bar_size > 0:
        raise ValueError(f"bar_size must be above 0, not {bar_size}")


def time_bars(df: DataFrame, *, bar_size: str = "1m", tie_breakers: Sequence[str] | None = None, sort: bool = False) -> DataFrame:
    """Bars by time bucket and symbol. Rows without a timestamp are dropped.

    One exchange on (bucket, symbol) behind a partial aggregate. The bucket's start keeps the timestamp column's name.
    """
    size = parse_duration(bar_size)
    trades = _trades(df, tie_breakers).where(F.col("__t").isNotNull())
    bars = trades.groupBy(bucket_start(F.col("__t"), size).alias("__bucket"), "__sym").agg(*_ohlcv())
    return _result(bars, [F.col("__bucket").alias(column_names.timestamp)], sort)


def tick_bars(df: DataFrame, *, bar_size: int = 100, split_by_date: bool = True, tie_breakers: Sequence[str] | None = None, sort: bool = False) -> DataFrame:
    """Bars of ``bar_size`` trades per symbol, counted anew each day unless ``split_by_date`` is off.

    Trades are numbered within (symbol, hour) and the counts of earlier hours added, so no task orders a symbol's whole history;
    bars are then combined on the map side.
    """
    _check_size(bar_size)
    numbered = _running(_trades(df, tie_breakers), split_by_date, F.lit(1).cast("long"))
    bars = numbered.withColumn("__bar", F.call_function("div", F.col("__hi") - 1, F.lit(int(bar_size)))).groupBy("__key", "__day", "__bar").agg(*_ohlcv())
    return _result(bars.withColumn("__sym", _symbol()), sort=sort)


def volume_bars(df: DataFrame, *, bar_size: float = 10_000, split_by_date: bool = True, tie_breakers: Sequence[str] | None = None, sort: bool = False) -> DataFrame:
    """Bars of ``bar_size`` traded units per symbol[, day]; a trade is split over as many bars as it fills.

    Sizes that are null or not above 0 are left out. With whole sizes and the running total ``hi`` after a trade and ``lo`` before
    it, the trade lies in bars ``lo div B .. (hi - 1) div B``: no row is replicated per unit and a busy symbol is spread over its
    hours. Fractional sizes are added up in order as they are, by :func:`bar_groups`, a (symbol[, day]) in one task; the volume
    column, a whole number, is their sum cut off.
    """
    _check_size(bar_size)
    trades = _trades(df, tie_breakers, positive_size=True)
    if isinstance(trades.schema["__s"].dataType, INTEGRAL):
        running = _running(trades.withColumn("__s", F.col("__s").cast("long")), split_by_date, F.col("__s"))
        pieces = _split(running.withColumnRenamed("__s", "__own"), F.col("__hi"), F.col("__own"), int(bar_size), "__bar", "__s")
    else:
        day = time_bucket(to_micros(F.col("__t")), DAY_US) if split_by_date else F.lit(0).cast("long")
        keyed = trades.withColumns({"__key": solid(F.col("__sym")), "__day": day})
        pieces = bar_groups(keyed, "__s", bar_size, partition_by=["__key", "__day"], order_by=[_ORDER])
        pieces = pieces.drop("__s").withColumnsRenamed({"bar_group__id": "__bar", "bar_group__amount": "__s"})
    bars = pieces.groupBy("__key", "__day", "__bar").agg(*_ohlcv())
    return _result(bars.withColumn("__sym", _symbol()), sort=sort)


_BLOCK = 64


class BarScan:
    """Cuts values in order into groups of ``bar_size``; two numbers of state carry over from batch to batch.

    With splits a value fills the current group and goes on into as many more as it needs; without, it goes whole to the current
    group, which closes once its sum reaches the size. Sums are taken in order in the values' own type; work is vectorised per
    group, not per value. Values that are null or not above 0 have no part with splits; without, null counts as 0.
    """

    def __init__(self, bar_size: float, allow_splits: bool = True, kind: str = "float64") -> None:
        self.kind = np.dtype(kind)
        self.size, self.splits = self.kind.type(bar_size), allow_splits
        self.sum, self.group = self.kind.type(0), 0

    def _first_full(self, values: np.ndarray, at: int) -> tuple[int, np.ndarray]:
        """Position of the value that fills the group, or the end, and the running sums before each value up to there."""
        width, start, sums = _BLOCK, at, [np.array([self.sum], dtype=self.kind)]
        while start < len(values):
            run = np.cumsum(np.concatenate([sums[-1][-1:], values[start : start + width]]), dtype=self.kind)[1:]
            full = np.flatnonzero(run >= self.size)
            if len(full):
                sums.append(run[: full[0]])
                return start + int(full[0]), np.concatenate(sums)
            sums.append(run)
            start, width = start + width, width * 2
        return len(values), np.concatenate(sums)

    def pieces(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, group, amount) of the next values."""
        values = np.asarray(values, dtype=self.kind)
        kept = np.flatnonzero(values > 0) if self.splits else np.arange(len(values))
        values = values[kept]
        rows, groups, amounts = [np.empty(0, dtype="int64")], [np.empty(0, dtype="int64")], [np.empty(0, dtype=self.kind)]
        at = 0
        while at < len(values):
            full, sums = self._first_full(values, at)
            whole = full if self.splits else min(full + 1, len(values))
            rows.append(kept[at:whole])
            groups.append(np.full(whole - at, self.group, dtype="int64"))
            amounts.append(values[at:whole])
            if full == len(values):
                self.sum = sums[-1]
                break
            rest = self.kind.type(0)
            if self.splits:
                parts = [self.size - sums[-1]]
                rest = values[full] - parts[0]
                while rest >= self.size:
                    parts.append(self.size)
                    rest = rest - self.size
                filled = len(parts)
                if rest > 0:
                    parts.append(rest)
                rows.append(np.full(len(parts), kept[full], dtype="int64"))
                groups.append(self.group + np.arange(len(parts)))
                amounts.append(np.array(parts, dtype=self.kind))
                self.group += filled
            else:
                self.group += 1
            self.sum, at = rest, full + 1
        return np.concatenate(rows), np.concatenate(groups), np.concatenate(amounts)


class DollarScan:
    """Fills bars share by share: a bar closes with the share that brings its value to ``bar_size``, and the rest of that share's
    value is dropped. Two numbers of state; whole trades are found by running sums, arithmetic per share is never done."""

    def __init__(self, bar_size: float) -> None:
        self.bar_size, self.bar = float(bar_size), 0
        self._scan = BarScan(bar_size, False)

    def pieces(self, prices: Sequence[float], sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bar, shares) of the next trades in order."""
        p, n = np.asarray(prices, dtype="float64"), np.asarray(sizes, dtype="int64")
        value = np.where(p > 0, n * p, 0.0)
        rows, bars, shares = [np.empty(0, dtype="int64")], [np.empty(0, dtype="int64")], [np.empty(0, dtype="int64")]
        scan, at, full_bar = self._scan, 0, self.bar_size
        while at < len(p):
            full, sums = scan._first_full(value, at)
            rows.append(np.arange(at, full))
            bars.append(np.full(full - at, self.bar))
            shares.append(n[at:full])
            scan.sum = sums[-1]
            if full == len(p):
                break
            price, left = float(p[full]), int(n[full])
            k = min(left, max(1, ceil((full_bar - float(scan.sum)) / price)))  # min: rounding at the edge, the whole trade fits
            per_bar = ceil(full_bar / price)
            whole, rest = divmod(left - k, per_bar)
            own = [k, *[per_bar] * whole, *([rest] if rest else [])]
            rows.append(np.full(len(own), full))
            bars.append(self.bar + np.arange(len(own)))
            shares.append(np.array(own))
            self.bar += 1 + whole
            scan.sum, at = np.float64(rest * price), full + 1
        return np.concatenate(rows), np.concatenate(bars), np.concatenate(shares)


def _scanned(in_order: DataFrame, key: str, make: Callable[[], object], feed: Callable[[object, pa.RecordBatch], tuple], drop: Sequence[str], schema: str | StructType, names: tuple[str, str]) -> DataFrame:
    """Rows taken by the pieces of a scan that starts anew with each key; the frame is sorted by key and order in its partitions.
    Batches stream through, so memory does not grow with a key's rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).dictionary_encode()
            codes = keys.indices.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
            found = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                name = keys.dictionary[int(codes[a])].as_py()
                if name != current:
                    current, state = name, make()
                row, group, amount = feed(state, batch.slice(a, b - a))
                found.append((row + a, group, amount))
            row, group, amount = (np.concatenate(x) for x in zip(*found))
            kept = batch.select([c for c in batch.schema.names if c not in drop]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(group), pa.array(amount)], names=[*kept.schema.names, *names])

    ship(in_order.sparkSession)
    return in_order.mapInArrow(scan, schema)


_KINDS = {"float": "float32", "double": "float64", "int": "int32"}


def bar_groups(df: DataFrame, measure: str, bar_size: float, *, allow_splits: bool = True, partition_by: Sequence[str] = (), order_by: Sequence[str]) -> DataFrame:
    """Groups of ``bar_size`` of any measure: the frame's rows with ``bar_group__id`` (from 0 per partition) and
    ``bar_group__amount`` (of the measure's type), one row per piece of a value.

    With ``allow_splits`` a value is split over as many groups as it fills; without, it goes whole to the current group, which
    closes once its sum reaches the size. ``order_by`` must make ties definite. The size is cut to the measure's type. With splits,
    values that are null or not above 0 give no row; without, null counts as 0. NaN values reach no size. An empty frame stays empty.

    Whole numbers with splits, ordered by a timestamp first, are grouped by running totals, which spread a partition that holds most
    rows. Everything else depends on the sums before it: a partition is scanned in order by one task, in batches and with two
    numbers of state, sorted by Spark; so it needs time, not memory.
    """
    require(df, measure, *partition_by, *order_by)
    require_type(df, measure, NUMERIC, "numeric")
    if taken := {"bar_group__id", "bar_group__amount"} & set(df.columns):
        raise ValueError(f"the frame already has {sorted(taken)}")
    if not order_by:
        raise ValueError("order_by must name a column")
    _check_size(bar_size)
    kind = df.schema[measure].dataType
    value = col(measure)
    if isinstance(kind, DecimalType):
        value, kind = value.cast("double"), DoubleType()
    dtype = _KINDS.get(kind.simpleString(), "int64")
    if dtype.startswith("int") and int(bar_size) < 1:
        raise ValueError("bar_size must be at least 1 for whole numbers")
    k, o, v, h, hi = (fresh(n, df.columns) for n in ("__key", "__order", "__value", "__hour", "__hi"))
    key = F.concat_ws("\x1f", *(solid(col(c)) for c in partition_by)) if partition_by else F.lit("")
    rows = df.withColumns({k: key, o: F.struct(*(col(c) for c in order_by)), v: value})
    if allow_splits and dtype.startswith("int") and isinstance(df.schema[order_by[0]].dataType, (TimestampNTZType, TimestampType)):
        rows = rows.where(F.col(v) > 0).withColumns({h: time_bucket(to_micros(col(order_by[0])), bucket_width(df)), v: F.col(v).cast("long")})
        total = running_totals(rows, [k], h, o, F.col(v), hi)
        out = _split(total, F.col(hi), F.col(v), int(bar_size), "bar_group__id", "bar_group__amount")
        return out.select(*(col(c) for c in df.columns), "bar_group__id", F.col("bar_group__amount").cast(kind).alias("bar_group__amount"))
    in_order = rows.repartition(k).sortWithinPartitions(k, o).drop(o)

    def feed(state: BarScan, batch: pa.RecordBatch) -> tuple:
        return state.pieces(batch.column(v).fill_null(0).to_numpy(zero_copy_only=False))

    schema = StructType([*df.schema.fields, StructField("bar_group__id", LongType()), StructField("bar_group__amount", kind)])
    return _scanned(in_order, k, lambda: BarScan(bar_size, allow_splits, dtype), feed, (k, v), schema, ("bar_group__id", "bar_group__amount"))


def _split(df: DataFrame, hi: Column, amount: Column, bar_size: int, bar: str, out: str) -> DataFrame:
    """Pieces of whole amounts with running totals ``hi``: an amount lies in bars ``lo div B .. (hi - 1) div B``."""
    b = F.lit(bar_size).cast("long")
    lo = hi - amount
    div = lambda x: F.call_function("div", x, b)
    cut = df.withColumn(bar, F.explode(F.sequence(div(lo), div(hi - 1))))
    return cut.withColumn(out, F.least(hi, (F.col(bar) + 1) * b) - F.greatest(lo, F.col(bar) * b))


def dollar_bars(df: DataFrame, *, bar_size: float = 1_000_000.0, split_by_date: bool = True, tie_breakers: Sequence[str] | None = None, sort: bool = False) -> DataFrame:
    """Bars of ``bar_size`` value per symbol[, day], filled share by share.

    The scan depends on its own resets, so a (symbol[, date]) is scanned in order by one task. The rows are sorted by Spark and pass
    through in Arrow batches with two numbers of state, so a long history needs time but no memory. Sizes must be integral; null or
    non-positive ones are left out, negative prices raise, NaN and zero prices add no value. Trades of a bar at the same price and
    time count once in n_trades.
    """
    _check_size(bar_size)
    trades = _trades(df, tie_breakers, positive_size=True)
    require_type(trades, "__s", INTEGRAL, "integral for dollar bars")
    checked = F.when(F.col("__p") < 0, F.raise_error(F.lit("dollar bars need prices of 0 or more")).cast("double")).otherwise(F.col("__p"))
    day = F.coalesce(F.to_date("__t").cast("string"), F.lit("")) if split_by_date else F.lit("")
    keyed = trades.select(F.concat(day, F.lit(_CUT), solid(F.col("__sym"))).alias("__key"), "__t", checked.alias("__p"), F.col("__s").cast("long").alias("__s"), _ORDER)
    in_order = keyed.repartition("__key").sortWithinPartitions("__key", _ORDER).drop(_ORDER)

    def feed(state: DollarScan, batch: pa.RecordBatch) -> tuple:
        return state.pieces(batch.column("__p").to_numpy(zero_copy_only=False), batch.column("__s").to_numpy(zero_copy_only=False))

    pieces = _scanned(in_order, "__key", lambda: DollarScan(bar_size), feed, ("__s",), "__key string, __t timestamp_ntz, __p double, __bar long, __s long", ("__bar", "__s"))
    merged = pieces.groupBy("__key", "__bar", "__t", "__p").agg(F.sum("__s").alias("__s")).withColumn(_ORDER, F.struct("__t", "__p"))
    bars = merged.groupBy("__key", "__bar").agg(*_ohlcv())
    symbol = F.expr(f"substring(__key, locate('{_CUT}', __key) + 1)")
    return _result(bars.withColumn("__sym", F.when(symbol != "", F.expr("substring(__key, locate('" + _CUT + "', __key) + 2)"))), sort=sort)
