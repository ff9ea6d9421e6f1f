"""Irregular readings onto a regular time grid."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import col, require
from tickloom.functions.durations import DAY_US, floor_to, from_micros, parse_duration, to_micros

_STRETCH = 4_096


def regular_grid(df: DataFrame, keys: Sequence[str], time: str, value: str, step: str | dt.timedelta, *, max_fill: int = 4, per_day: bool = False, bounds: tuple[dt.datetime, dt.datetime] | str | None = None) -> DataFrame:
    """One row per key and grid slot ``[start, start + step)`` from the first to the last slot with a reading.

    Columns out: the keys, ``slot_start`` (timestamp_ntz), ``value``, ``status``. Status is ``observed`` (value: the slot's last
    reading), ``interpolated`` (linear in time at the slot's start, between the readings around it) for gaps of up to ``max_fill``
    slots, ``gap`` (null) for longer ones, and ``leading`` / ``trailing`` (null / last value) between the readings and ``bounds``:
    a pair of times, or ``"day"`` for whole days when ``per_day`` restarts the series each calendar day.

    Readings are first reduced to one row per key and slot, combined on the map side, so a busy key costs one row per slot in the
    windows; lead pairs consecutive slots and only the slots between them are exploded. Rows with a null key, time or value and
    NaN values are left out; equal times go to the largest value. Other columns are ignored. Empty input gives an empty frame.
    """
    by = parse_duration(step)
    if by.months or by.micros <= 0:
        raise ValueError("step must be a fixed length above 0")
    if bounds == "day" and not per_day:
        raise ValueError("bounds='day' needs per_day")
    require(df, *keys, time, value)
    width = by.micros
    names = [f"__k{i}" for i in range(len(keys))]
    v = col(value).cast("double")
    kept = v.isNotNull() & ~F.isnan(v) & col(time).isNotNull()
    for k in keys:
        kept = kept & col(k).isNotNull()
    us = to_micros(col(time))
    readings = df.where(kept).select(*(col(k).alias(n) for k, n in zip(keys, names)), us.alias("__us"), v.alias("__v"))
    day = [floor_to(F.col("__us"), DAY_US).alias("__day")] if per_day else []
    origin = 4 * DAY_US if width % (7 * DAY_US) == 0 else 0
    start = floor_to(F.col("__us"), width, origin)
    if per_day and DAY_US % width:
        start = floor_to(F.col("__us"), DAY_US) + floor_to(F.pmod(F.col("__us"), F.lit(DAY_US)), width)
    reading = F.struct("__us", "__v")
    slots = readings.groupBy(*names, *day, start.alias("__slot")).agg(F.min(reading).alias("__first"), F.max(reading).alias("__last"))
    w = Window.partitionBy(*names, *(["__day"] if per_day else [])).orderBy("__slot")
    paired = slots.select("*", F.lead("__slot").over(w).alias("__next"), F.lead("__first").over(w).alias("__after"), F.lag("__slot").over(w).isNull().alias("__head"))
    slot, following = F.col("__slot"), F.col("__next")
    low, high = slot, slot
    if bounds == "day":
        low, high = F.col("__day"), F.col("__day") + F.lit(DAY_US - 1)
        high = F.col("__day") + floor_to(F.lit(DAY_US - 1).cast("long"), width)
    elif bounds is not None:
        lo_us, hi_us = (F.lit(int((b - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))).cast("long") for b in bounds)
        low, high = floor_to(lo_us, width, origin), floor_to(hi_us, width, origin)
    begin = F.when(F.col("__head"), F.least(low, slot)).otherwise(slot)
    end = F.when(following.isNull(), F.greatest(high, slot)).otherwise(following - F.lit(width))
    # A long gap is cut before its slots are listed, so no row holds more than _STRETCH of them.
    stretch = F.lit(width * _STRETCH).cast("long")
    cut = paired.withColumn("__end", end).withColumn("__c", F.explode(F.sequence(begin, F.col("__end"), stretch)))
    grid = cut.withColumn("__g", F.explode(F.sequence(F.col("__c"), F.least(F.col("__c") + stretch - F.lit(width), F.col("__end")), F.lit(width).cast("long"))))
    g, last, after = F.col("__g"), F.col("__last"), F.col("__after")
    missing = (following - slot) / F.lit(width) - 1
    status = F.when(g == slot, "observed").when(g < slot, "leading").when(following.isNull(), "trailing").when(missing <= max_fill, "interpolated").otherwise("gap")
    x0, x1 = last["__us"], after["__us"]
    line = last["__v"] + (after["__v"] - last["__v"]) * ((g - x0) / (x1 - x0))
    filled = F.when((g == slot) | ((g > slot) & following.isNull()), last["__v"]).when((g > slot) & (missing <= max_fill), line)
    return grid.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), from_micros(g).alias("slot_start"), filled.alias("value"), status.alias("status"))
