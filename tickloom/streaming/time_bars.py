"""Time bars over a stream of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.config import column_names
from tickloom.functions.columns import col, require
from tickloom.functions.durations import WEEK_US, parse_duration


def streaming_time_bars(trades: DataFrame, *, bar_size: str = "1m", lateness: str = "10 minutes") -> DataFrame:
    """The bars of :func:`tickloom.time_bars` for a streaming frame: a bar is final once the watermark, ``lateness`` behind the
    latest time seen, passes its end; later trades are dropped. Fixed bar sizes only. State holds one row per open bar and symbol.

    Also works on a batch frame, where nothing is late. Rows with a null price or time are left out.
    """
    ts, sym, price, size = (getattr(column_names, n) for n in ("timestamp", "symbol", "price", "size"))
    require(trades, ts, sym, price, size)
    by = parse_duration(bar_size)
    if by.months or by.micros <= 0:
        raise ValueError("streaming bars need a fixed size above 0")
    origin = "4 days" if by.micros % WEEK_US == 0 else "0 seconds"
    width = f"{by.micros} microseconds"
    t = col(ts).cast("timestamp")
    rows = trades.where(col(price).isNotNull()).select(t.alias("t"), col(sym).cast("string").alias("sym"), col(price).cast("double").alias("p"), col(size).alias("s"))
    number, order = F.when(~F.isnan("p"), F.col("p")), F.struct("t", "p", "s")
    bars = rows.withWatermark("t", lateness).groupBy(F.window("t", width, None, origin).alias("w"), "sym").agg(
        F.min("t").alias("a"), F.max("t").alias("b"), F.min_by("p", order).alias("open"), F.max(number).alias("high"), F.min(number).alias("low"), F.max_by("p", order).alias("close"),
        F.try_divide(F.sum(F.col("s") * F.col("p")), F.sum("s")).alias("vwap"), F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("volume"), F.count(F.lit(1)).alias("n_trades"),
    )
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    nan = F.lit(float("nan"))
    return bars.select(ntz("w.start").alias(ts), F.col("sym").alias(sym), ntz("a").alias(f"{ts}_start"), ntz("b").alias(f"{ts}_end"), "open", F.coalesce("high", nan).alias("high"), F.coalesce("low", nan).alias("low"), "close", "vwap", "volume", "n_trades")
