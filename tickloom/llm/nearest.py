"""Pairing records of two tables by nearest time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import col, require
from tickloom.functions.durations import parse_duration, to_micros

#: Width of an index partition in tolerances; right rows near its edges are copied to the neighbour, about 4 / WIDTH of them.
WIDTH = 64


def nearest_match(left: DataFrame, right: DataFrame, *, left_key: str, left_time: str, left_id: str, right_key: str, right_time: str, right_id: str, tolerance: str | dt.timedelta, keep_unmatched: bool = False) -> DataFrame:
    """For each left row the right row of the same key that is nearest in time, at most ``tolerance`` away (included).

    Columns out: ``left_id``, ``right_id``, ``offset_us`` (right minus left). At equal distance the earlier right row is taken, at
    equal times the smallest right id. Rows with a null key or time match nothing; with ``keep_unmatched`` such left rows, and
    those without a partner, come out with nulls. Repeated left rows come out as often. Other columns, of any name, are ignored.

    Every distinct right time owns the interval of left times nearest to it: from the midpoint to the time before (excluded) to
    the midpoint to the time after, cut to the tolerance. Intervals of a key are disjoint, so within an index partition (key, time
    bin) the interval of a left row is the last one that starts at or before it: a sort and a running window, no candidate pairs.
    Midpoints are kept doubled, in whole microseconds. A busy key is spread over its time bins; a right row is copied to the
    neighbouring bin only within two tolerances of the edge.
    """
    tol = parse_duration(tolerance)
    if tol.months or tol.micros < 0:
        raise ValueError("tolerance must be a fixed length of at least 0")
    require(left, left_key, left_time, left_id)
    require(right, right_key, right_time, right_id)
    t = tol.micros
    width = F.lit(max(1, t) * WIDTH).cast("long")
    bin_of = lambda us: ((us - F.pmod(us, width)) / width).cast("long")
    us = F.col("us")

    seen = right.where(col(right_key).isNotNull() & col(right_time).isNotNull()).select(col(right_key).alias("k"), to_micros(col(right_time)).alias("us"), col(right_id).alias("rid"))
    offset, home = F.pmod(us, width), bin_of(us)
    near = F.array_compact(F.array(home, F.when(offset < 2 * t, home - 1), F.when(width - offset <= 2 * t, home + 1)))
    copied = seen.withColumn("bin", F.explode(near))
    w = Window.partitionBy("k", "bin").orderBy("us", "rid")
    distinct = copied.withColumn("before", F.lag("us").over(w)).where("before is null or before <> us")
    lo = F.greatest(us * 2 - 2 * t, us + F.lag("us").over(w) + 1)
    hi = F.least(us * 2 + 2 * t, us + F.lead("us").over(w))
    owned = distinct.select("k", "bin", "us", "rid", lo.alias("lo"), hi.alias("hi")).where(F.col("bin") == bin_of(us))
    half = lambda x: (x - F.pmod(x, F.lit(2))) / 2
    first, last = bin_of(half(F.col("lo") + 1).cast("long")), bin_of(half(F.col("hi")).cast("long"))
    index = owned.where("lo <= hi").select("k", F.explode(F.sequence(first, F.greatest(first, last))).alias("bin"), F.col("lo").alias("at"), F.lit(0).alias("side"), F.struct("hi", "rid", "us").alias("own"), F.lit(None).cast(left.schema[left_id].dataType).alias("lid"))
    nothing = F.lit(None).cast(index.schema["own"].dataType)
    valid = col(left_key).isNotNull() & col(left_time).isNotNull()
    asked = left.where(valid).select(col(left_key).alias("k"), to_micros(col(left_time)).alias("us"), col(left_id).alias("lid"))
    asked = asked.select("k", bin_of(us).alias("bin"), (us * 2).alias("at"), F.lit(1).alias("side"), nothing.alias("own"), "lid")
    running = Window.partitionBy("k", "bin").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = index.unionByName(asked).withColumn("own", F.last("own", ignorenulls=True).over(running)).where("side = 1")
    hit = F.col("own.hi") >= F.col("at")
    out = found.select(F.col("lid").alias("left_id"), F.when(hit, F.col("own.rid")).alias("right_id"), F.when(hit, F.col("own.us") - F.col("at") / 2).cast("long").alias("offset_us"))
    if not keep_unmatched:
        return out.where("offset_us is not null")
    none = left.where(~valid).select(col(left_id).alias("left_id"), F.lit(None).cast(out.schema["right_id"].dataType).alias("right_id"), F.lit(None).cast("long").alias("offset_us"))
    return out.unionByName(none)
