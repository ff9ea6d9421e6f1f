"""Seeded trades for examples, tests and benchmarks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.durations import DAY_US, from_micros


def generate_trade_data(spark: SparkSession, n_rows: int, n_companies: int = 3, *, seed: int = 0, start: dt.datetime = dt.datetime(2024, 1, 1), days: int = 5) -> DataFrame:
    """``ts_event``, ``price`` (1 to 100), ``size`` (10,000 to 100,000), ``symbol``: unordered trades over a few days. Each value is a
    hash of the row number and the seed, so the same call gives the same rows on any cluster."""

    def below(n: int, salt: int) -> Column:
        return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(n))

    first = int((start - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    return spark.range(n_rows).select(
        from_micros(F.lit(first).cast("long") + below(days * DAY_US, 1)).alias("ts_event"),
        (F.lit(1) + below(9_901, 2) / 100).alias("price"),
        (F.lit(10_000) + below(90_001, 3)).cast("long").alias("size"),
        F.concat(F.lit("SYM"), below(n_companies, 4).cast("string")).alias("symbol"),
    )
