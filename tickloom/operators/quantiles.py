"""Exact order statistics per key, without a task per key: a radix selection in two steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chosen_bins(bins: DataFrame, keys: Sequence[str], low: Column, high: Column) -> DataFrame:
    """The bins in which the ``low``-th and ``high``-th smallest value (from 1) of each key lie.

    ``bins`` has the keys, ``bin`` (an integer that never falls as the value grows) and ``n``, the values in it, in any number of
    rows; low and high are integer expressions over ``total``, the key's number of values. Columns out: keys, bin, total, below
    (values in lower bins), rank; one or two rows a key.
    """
    by = list(keys)
    w = Window.partitionBy(*by)
    cum = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    summed = bins.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    counted = summed.select(*by, "bin", "n", F.sum("n").over(w).alias("total"), (cum - F.col("n")).alias("below"))
    ranks = F.array_distinct(F.array(low.cast("long"), high.cast("long")))
    wanted = counted.select(*by, "bin", "n", "total", "below", F.explode(ranks).alias("rank"))
    return wanted.where("rank > below and rank <= below + n").drop("n")


def selected(wanted: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys, ``total`` and ``statistic``, the mean of the chosen ranks' values. ``values`` (keys, bin, value, n) may hold values of
    other bins too; those of chosen bins are added up on the map side."""
    by = [*keys, "bin"]
    near = values.join(wanted.select(*by).distinct(), by, "left_semi").groupBy(*by, "value").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by, "rank").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    hits = wanted.join(near, by).withColumn("upto", upto + F.col("below")).where("rank <= upto and rank > upto - n")
    return hits.groupBy(*keys).agg(F.max("total").alias("total"), F.avg("value").alias("statistic"))


def order_statistics(counts: DataFrame, keys: Sequence[str], low: Column, high: Column) -> DataFrame:
    """Mean of the ``low``-th and ``high``-th smallest value of each key of ``counts`` (keys, bin, value, n), exact."""
    return selected(chosen_bins(counts, keys, low, high), counts, keys)
