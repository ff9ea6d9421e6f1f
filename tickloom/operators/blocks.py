"""Ordered computations over keys of any size: running totals, bounded row frames, as-of lookups and exponential moments.

Each cuts a key into pieces that tasks take alone and moves what must cross the cuts as small tables: totals per time bucket, copies of
the rows next to a cut, the last observation per bucket, one state per shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tickloom.functions.columns import col, fresh, require
from tickloom.functions.durations import DAY_US, to_micros
from tickloom.operators.sharding import ordered_shards, tables_of
from tickloom.sources.tables import input_bytes

HOUR_US = 3_600_000_000
_TOTALS = 4_096
_NEVER = -(2**62)


def solid(key: Column) -> Column:
    """A string that stands for a key and is never null, so that windows and joins on it share one exchange."""
    text = key.cast("string")
    return F.when(text.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), text))


def time_bucket(us: Column, width: int = HOUR_US) -> Column:
    """Number of the time bucket; null times have the first one."""
    return F.coalesce(((us - F.pmod(us, F.lit(width))) / F.lit(width)).cast("long"), F.lit(_NEVER))


def bucket_width(df: DataFrame) -> int:
    """Microseconds of a time bucket of running totals: an hour, halved for each doubling of the input beyond 16 GB down to a second,
    so that a busy key's bucket stays a task's work."""
    halvings = max(0, (input_bytes(df) >> 34).bit_length())
    return max(1_000_000, HOUR_US >> halvings)


def running_totals(df: DataFrame, keys: Sequence[str], bucket: str, order: str, amount: Column, out: str, over: Sequence[str] | None = None) -> DataFrame:
    """Running total of an integral ``amount`` per ``over`` (the keys unless given) up to and with each row.

    Rows are summed in order within (keys, bucket); the totals of earlier buckets, one row per key and bucket, are added by a join
    on the same columns. These totals are themselves summed within ``_TOTALS`` buckets first, so that no task sums a key's whole
    history. Buckets must rise with the order, keys and buckets must not be null.
    """
    over = list(over if over is not None else keys)
    at = [*keys, bucket]
    own, inner, total, before, coarse, earlier = (fresh(n, df.columns) for n in ("__amount", "__inner", "__total", "__before", "__coarse", "__earlier"))
    rows = df.withColumn(own, amount)
    partial = F.sum(own).over(Window.partitionBy(*at).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    totals = rows.groupBy(*at).agg(F.sum(own).alias(total)).withColumn(coarse, F.floor(F.col(bucket) / F.lit(_TOTALS)))
    ahead = lambda x, by, order: F.coalesce(F.sum(x).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = totals.groupBy(*dict.fromkeys([*over, *keys]), coarse).agg(F.sum(total).alias(total))
    groups = groups.select(*(F.col(k) for k in dict.fromkeys([*over, *keys])), coarse, ahead(total, over, coarse).alias(earlier))
    totals = totals.withColumn(before, ahead(total, [*over, coarse], bucket)).join(groups, [*dict.fromkeys([*over, *keys]), coarse])
    totals = totals.select(*at, (F.col(before) + F.col(earlier)).alias(before))
    return rows.withColumn(inner, partial).join(totals, at).withColumn(out, F.col(inner) + F.col(before)).drop(own, inner, before)


def over_blocks(df: DataFrame, compute: Callable[[WindowSpec], Column], out: str, *, partition_by: Sequence[str], order_by: Sequence[str], time: str, before: int = 0, after: int = 0, block: int = 100_000, number: str | None = None) -> DataFrame:
    """The frame with ``out``, a window expression that looks at most ``before`` rows back and ``after`` rows ahead.

    Rows are numbered per partition by running totals and cut into blocks of ``block`` rows; those near a cut are copied to the
    neighbours, so a key that holds most rows is spread over its blocks. ``time`` is a timestamp that leads ``order_by``. ``number``
    names a column for each row's number in its partition, from 1.
    """
    require(df, *partition_by, *order_by, time)
    if order_by[0] != time:
        raise ValueError("order_by must begin with the time column")
    size = max(block, 4 * (before + after))
    k, h, o, rn, b = (fresh(n, df.columns) for n in ("__key", "__hour", "__order", "__rn", "__block"))
    key = F.concat_ws("\x1f", *(solid(col(c)) for c in partition_by)) if partition_by else F.lit("")
    rows = df.withColumns({k: key, h: time_bucket(to_micros(col(time)), bucket_width(df)), o: F.struct(*(col(c) for c in order_by))})
    numbered = running_totals(rows, [k], h, o, F.lit(1).cast("long"), rn)
    pos, home = F.pmod(F.col(rn) - 1, F.lit(size)), ((F.col(rn) - 1 - F.pmod(F.col(rn) - 1, F.lit(size))) / size).cast("long")
    places = F.array_compact(F.array(home, F.when(pos >= size - before, home + 1) if before else F.lit(None).cast("long"), F.when(pos < after, home - 1) if after else F.lit(None).cast("long")))
    copied = numbered.withColumn(b, F.explode(places))
    done = copied.withColumn(out, compute(Window.partitionBy(k, b).orderBy(rn)))
    done = done.where(F.col(b) == home)
    return (done.withColumnRenamed(rn, number) if number else done.drop(rn)).drop(k, h, o, b)


def asof(rows: DataFrame, shift: int, *, forward: bool, width: int | None = None, asked: Column | None = None) -> DataFrame:
    """``rows`` (k, us, tie, value and others) with ``found``: the value of the last row of the same k at or before us - shift, or
    of the first at or after us + shift. Equal times: the largest tie backward, the smallest forward. Null times find nothing and are
    not found. k must not be null. ``asked`` replaces us + shift or us - shift by a time of each row's own.

    Rows and questions meet in time buckets at least ``shift`` wide; a question that its bucket does not answer takes the nearest
    observation of the buckets before (after), which one row per key and bucket carries along.
    """
    width = width or max(shift, DAY_US)
    us = F.col("us")
    asked = asked if asked is not None else us + shift if forward else us - shift
    seen = F.struct(us.alias("us"), F.col("tie").alias("tie"), F.col("value").alias("value"))
    whole = F.struct(*(F.col(c) for c in rows.columns))
    timed = rows.where("us is not null")
    none_seen, none_row = F.lit(None).cast(rows.select(seen.alias("x")).schema["x"].dataType), F.lit(None).cast(rows.select(whole.alias("x")).schema["x"].dataType)
    observed = timed.select("k", time_bucket(us, width).alias("b"), us.alias("at"), F.lit(0).alias("side"), seen.alias("seen"), none_row.alias("row"))
    questions = timed.select("k", time_bucket(asked, width).alias("b"), asked.alias("at"), F.lit(1).alias("side"), none_seen.alias("seen"), whole.alias("row"))
    events = observed.unionByName(questions)
    ways = [F.col("at").desc() if forward else F.col("at"), F.col("side"), F.col("seen").desc() if forward else F.col("seen")]
    running = Window.partitionBy("k", "b").orderBy(*ways).rowsBetween(Window.unboundedPreceding, 0)
    edge = (F.min if forward else F.max)("seen").alias("__edge")
    buckets = events.groupBy("k", "b").agg(edge)
    others = Window.partitionBy("k").orderBy(F.col("b").desc() if forward else F.col("b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("k", "b", F.last("__edge", ignorenulls=True).over(others).alias("__carried"))
    inside = events.withColumn("__in", F.last("seen", ignorenulls=True).over(running)).where("side = 1").select("k", "b", "row", "__in")
    answered = inside.join(carried, ["k", "b"]).select("row.*", F.coalesce("__in", "__carried")["value"].alias("found"))
    rest = rows.where("us is null").withColumn("found", F.lit(None).cast(answered.schema["found"].dataType))
    return answered.unionByName(rest)


def _moments(x: np.ndarray, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sum of weights, of squared weights, weighted mean, weighted squares about it and count, up to each position; weights decay
    with every position, also those without value."""
    valid = ~np.isnan(x)
    s, v = pd.Series(x), pd.Series(valid.astype(float))
    n = np.arange(1, len(x) + 1)
    sums = lambda q: v.ewm(alpha=1 - q, adjust=True).mean().to_numpy() * ((1 - q**n) / (1 - q))
    w, w2 = sums(decay), sums(decay * decay)
    e = s.ewm(alpha=1 - decay, adjust=True)
    return w, w2, e.mean().fillna(0).to_numpy(), e.var(bias=True).fillna(0).to_numpy() * w, np.cumsum(valid)


def _joined(state: tuple | None, local: tuple, decay: float, steps: np.ndarray | int) -> tuple:
    """Moments of a series that goes on from a state."""
    if state is None:
        return local
    w0, w20, m0, s0, n0 = state
    q = decay**steps
    w, w2, m, s, n = local
    a = q * w0
    total = a + w
    share = np.divide(a, total, out=np.zeros_like(total, dtype=float), where=total > 0) if isinstance(total, np.ndarray) else (a / total if total > 0 else 0.0)
    return total, q * q * w20 + w2, share * m0 + (1 - share) * m, q * s0 + s + share * w * (m0 - m) ** 2, n0 + n


_STATE = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("size", pa.int64()), ("moments", pa.list_(pa.float64()))])


def ewm_std(df: DataFrame, key: str, order: Sequence[str], value: str, span: float, keep: Sequence[str], out: str) -> DataFrame:
    """``keep`` and ``out``: exponentially weighted, bias-corrected standard deviation of ``value`` per key in order; 0.0 at the
    first value, null where the value is. ``key`` is a string that is never null.

    The moments are carried over shard edges: two Arrow passes over even shards, five numbers per shard (of which there are at most
    ``sharding.MOST_SHARDS``) collected and broadcast. The jobs of the first pass run when the function is called.
    """
    decay = 1 - 2 / (span + 1)
    kept = list(keep)
    columns = list(dict.fromkeys([key, value, *kept]))
    shards = ordered_shards(df, key, order, columns)
    ts = df.select(*kept).schema

    def parts(t: pa.Table):
        names = t[key].combine_chunks().dictionary_encode()
        codes = names.indices.to_numpy(zero_copy_only=False)
        x = t[value].to_numpy().astype(float)
        cuts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(x)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield names.dictionary[int(codes[a])].as_py(), x[a:b], t.slice(a, b - a)

    def summarise(batches):
        for shard, t in tables_of(batches):
            own = [(name, x) for name, x, _ in parts(t)]
            (first, _), (last, x) = own[0], own[-1]
            yield pa.RecordBatch.from_pylist([{"shard": shard, "n": len(own), "first": first, "last": last, "size": len(x), "moments": [float(m[-1]) for m in _moments(x, decay)]}], schema=_STATE)

    states = shards.mapInArrow(summarise, "shard long, n long, first string, last string, size long, moments array<double>").orderBy("shard").collect()  # one per shard
    enter = np.full((states[-1].shard + 1 if states else 0, 5), np.nan)
    name, state = None, None
    for s in states:
        state = state if s.first == name else None
        if state is not None:
            enter[s.shard] = state
        state = _joined(state if s.n == 1 else None, tuple(s.moments), decay, s.size)
        name = s.last
    shared = df.sparkSession.sparkContext.broadcast(enter)

    def finish(batches):
        for shard, t in tables_of(batches):
            start = shared.value[shard]
            before = None if np.isnan(start[0]) else tuple(start.tolist())
            for _, x, own in parts(t):
                w, w2, _, s, n = _joined(before, _moments(x, decay), decay, np.arange(1, len(x) + 1))
                before = None
                with np.errstate(divide="ignore", invalid="ignore"):
                    std = np.sqrt(np.maximum(s, 0) / w * (w * w) / (w * w - w2))
                std = np.where(n <= 1, 0.0, std)
                yield from own.select(kept).append_column(out, pa.array(std, mask=np.isnan(x) | np.isnan(std))).to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ts.fields)
    return shards.mapInArrow(finish, f"{fields}, `{out}` double")
