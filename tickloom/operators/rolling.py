"""Totals over trailing days from segment trees per entity and time shard.

A tree is a table (keys, shard, level, node, sums): node ``n`` of level ``l`` holds the totals of days ``n * 2^l .. (n + 1) * 2^l - 1``,
days counted from 1970. A shard is the ``2^height`` days under one top node, so no node crosses shards and a correction to a day
touches ``height + 1`` nodes of one shard.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import col, require
from tickloom.sources.tables import stored

HEIGHT = 6


def latest_revision(df: DataFrame, id_column: str, revision: str, columns: Sequence[str]) -> DataFrame:
    """``columns`` of the highest revision of each id (null revisions lowest; equal ones: the largest remaining values). Null ids
    are left out. One exchange on the id."""
    require(df, id_column, revision, *columns)
    names = [f"__c{i}" for i in range(len(columns))]
    rows = df.where(col(id_column).isNotNull()).select(col(id_column).alias("__id"), col(revision).alias("__r"), *(col(c).alias(n) for c, n in zip(columns, names)))
    w = Window.partitionBy("__id").orderBy(F.col("__r").desc_nulls_last(), *(F.col(n).desc_nulls_last() for n in names))
    return rows.withColumn("__i", F.row_number().over(w)).where("__i = 1").select(F.col("__id").alias(id_column), *(F.col(n).alias(c) for c, n in zip(columns, names)))


def _up(day: Column, level: int) -> Column:
    return F.shiftright(day, level)


def _nodes(daily: DataFrame, keys: Sequence[str], sums: Sequence[str], height: int) -> DataFrame:
    """The totals of every node above the given days."""
    nodes = F.array(*(F.struct(F.lit(level).alias("level"), _up(F.col("day"), level).alias("node")) for level in range(height + 1)))
    spread = daily.select(*(col(k) for k in keys), _up(F.col("day"), height).alias("shard"), F.explode(nodes).alias("__n"), *(col(s) for s in sums))
    flat = spread.select(*(col(k) for k in keys), "shard", "__n.level", "__n.node", *(col(s) for s in sums))
    return flat.groupBy(*(col(k) for k in keys), "shard", "level", "node").agg(*(F.sum(col(s)).alias(s) for s in sums))


def build_tree(df: DataFrame, keys: Sequence[str], day: str, measures: Mapping[str, Column], *, height: int = HEIGHT) -> DataFrame:
    """Segment trees over ``measures`` (name -> summable column; null counts as 0), one per combination of ``keys`` and shard.

    Rows are reduced per key and day on the map side first; the tree grows with keys times days, not with rows. Rows with a null
    key or day are left out. Names of keys and measures must not be day, shard, level or node.
    """
    require(df, *keys, day)
    if bad := {*keys, *measures} & {"day", "shard", "level", "node"}:
        raise ValueError(f"these names are the tree's own: {sorted(bad)}")
    kept = col(day).isNotNull()
    for k in keys:
        kept = kept & col(k).isNotNull()
    rows = df.where(kept).select(*(col(k) for k in keys), F.unix_date(col(day).cast("date")).cast("long").alias("day"), *(F.coalesce(m, F.lit(0)).alias(n) for n, m in measures.items()))
    daily = rows.groupBy(*(col(k) for k in keys), "day").agg(*(F.sum(col(n)).alias(n) for n in measures))
    return _nodes(daily, keys, list(measures), height)


def update_tree(tree: DataFrame, corrections: DataFrame, keys: Sequence[str], day: str, measures: Sequence[str], *, height: int = HEIGHT) -> DataFrame:
    """The tree with late corrections (differences per key and day) added to the ancestors of the corrected days; all other nodes
    pass through, nodes of days not seen before are added."""
    deltas = build_tree(corrections, keys, day, {m: col(m) for m in measures}, height=height)
    ids = [*keys, "shard", "level", "node"]
    d = deltas.select(*(col(i) for i in ids), *(col(m).alias(f"__d_{m}") for m in measures))
    both = tree.join(d, ids, "full_outer")
    return both.select(*(col(i) for i in ids), *((F.coalesce(col(m), F.lit(0)) + F.coalesce(col(f"__d_{m}"), F.lit(0))).cast(tree.schema[m].dataType).alias(m) for m in measures))


def save_tree(tree: DataFrame, path: str) -> None:
    """Write a tree partitioned by shard."""
    tree.repartition("shard", "level").write.mode("overwrite").partitionBy("shard").parquet(path)


def correct_saved_tree(spark, path: str, corrections: DataFrame, keys: Sequence[str], day: str, measures: Sequence[str], *, height: int = HEIGHT) -> None:
    """Correct a saved tree in place: only the shards (one per 2^height days) that hold a corrected day are read and rewritten."""
    days = corrections.where(col(day).isNotNull()).select(_up(F.unix_date(col(day).cast("date")).cast("long"), height).alias("shard")).distinct()
    touched = [r[0] for r in days.collect()]  # at most one number per 2^height days of history
    saved = spark.read.parquet(path)
    part = saved.where(F.col("shard").isin(touched)).withColumn("shard", F.col("shard").cast("long"))
    new = stored(update_tree(part, corrections, keys, day, measures, height=height), "tree")
    new.repartition("shard", "level").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def _node(level: int):
    return lambda x: F.struct(F.lit(level).alias("level"), x.alias("node"))


def cover(first: Column, last: Column, height: int = HEIGHT) -> Column:
    """The fewest nodes (level, node) that make up the days first..last: at most two per level below the top."""
    parts = []
    for level in range(height + 1):
        size = F.lit(1 << level).cast("long")
        lo = _up(first + size - 1, level)
        hi = _up(last + 1, level)
        node = _node(level)
        open_ = lo < hi
        if level == height:
            parts.append(F.when(open_, F.transform(F.sequence(lo, hi - 1), node)).otherwise(F.array().cast("array<struct<level:int,node:bigint>>")))
        else:
            pick = F.array(F.when(open_ & (F.pmod(lo, F.lit(2)) == 1), node(lo)), F.when(open_ & (F.pmod(hi, F.lit(2)) == 1), node(hi - 1)))
            parts.append(F.array_compact(pick))
    return F.flatten(F.array(*parts))


def range_totals(tree: DataFrame, asked: DataFrame, keys: Sequence[str], measures: Sequence[str], *, height: int = HEIGHT) -> DataFrame:
    """Totals for each row of ``asked`` (keys, first_day, last_day as days since 1970, and any columns that tell rows apart).
    Ranges without data come out as 0."""
    ids = asked.columns
    wanted = asked.select("*", F.explode(cover(F.col("first_day"), F.col("last_day"), height)).alias("__n")).select(*(col(i) for i in ids), F.col("__n.level").alias("__level"), F.col("__n.node").alias("__node"))
    t = tree.select(*(col(k).alias(f"__t{i}") for i, k in enumerate(keys)), F.col("level").alias("__tl"), F.col("node").alias("__tn"), *(col(m).alias(f"__m_{m}") for m in measures))
    on = (F.col("__level") == F.col("__tl")) & (F.col("__node") == F.col("__tn"))
    for i, k in enumerate(keys):
        on = on & (col(k) == F.col(f"__t{i}"))
    joined = wanted.join(t, on, "left")
    return joined.groupBy(*(col(i) for i in ids)).agg(*(F.coalesce(F.sum(col(f"__m_{m}")), F.lit(0)).alias(m) for m in measures))


def trailing_totals(tree: DataFrame, keys: Sequence[str], measures: Sequence[str], windows: Sequence[int] = (7, 30), *, height: int = HEIGHT) -> DataFrame:
    """For each key and each day from its first to its last, with or without data: totals over the last ``n`` days for each n.

    Columns out: the keys, ``day`` (date), ``<measure>_<n>``.
    """
    leaves = tree.where("level = 0").groupBy(*(col(k) for k in keys)).agg(F.min("node").alias("__a"), F.max("node").alias("__b"))
    days = leaves.select(*(col(k) for k in keys), F.explode(F.sequence("__a", "__b")).alias("last_day"))
    asked = days.select("*", F.explode(F.array(*(F.lit(n) for n in windows))).alias("window")).withColumn("first_day", F.col("last_day") - F.col("window") + 1)
    totals = range_totals(tree, asked, keys, measures, height=height)
    per = [F.max(F.when(F.col("window") == n, col(m))).alias(f"{m}_{n}") for n in windows for m in measures]
    wide = totals.groupBy(*(col(k) for k in keys), "last_day").agg(*per)
    return wide.select(*(col(k) for k in keys), F.date_from_unix_date(F.col("last_day").cast("int")).alias("day"), *(F.col(f"{m}_{n}") for n in windows for m in measures))
