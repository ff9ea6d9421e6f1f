import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.functions.columns import fresh, parse_into_expr, require, tidy_symbol
from tickloom.functions.durations import Duration, bucket_start, from_micros, parse_duration, shifted, to_micros


def test_parse_into_expr(spark):
    one = spark.createDataFrame([(7, "x")], "a int, b string")
    c = F.col("a")
    assert parse_into_expr(c) is c
    out = one.select(
        parse_into_expr("a").alias("name"), parse_into_expr("a", str_as_lit=True).alias("text"), parse_into_expr([1, 2]).alias("array"), parse_into_expr([1, 2], dtype="bigint").alias("typed"),
        parse_into_expr(42).alias("n"), parse_into_expr(42, dtype="double").alias("d"), parse_into_expr(True).alias("t"), parse_into_expr(None).alias("none"),
    )
    assert tuple(out.first()) == (7, "a", [1, 2], [1, 2], 42, 42.0, True, None)
    kinds = dict(out.dtypes)
    assert (kinds["typed"], kinds["n"], kinds["d"]) == ("array<bigint>", "int", "double")
    assert [r[0] for r in one.select(parse_into_expr([1, 2, 3], list_as_lit=False)).collect()] == [1, 2, 3]


@pytest.mark.parametrize(("text", "expected"), [
    ("15m", Duration(0, 900_000_000)), ("1d12h", Duration(0, 129_600_000_000)), ("-2h", Duration(0, -7_200_000_000)), ("1mo", Duration(1, 0)), ("1y2q", Duration(18, 0)), ("3w", Duration(0, 1_814_400_000_000)),
    ("250ms", Duration(0, 250_000)), ("7us", Duration(0, 7)), ("1500ns", Duration(0, 1)), (dt.timedelta(hours=2), Duration(0, 7_200_000_000)),
])
def test_durations(text, expected):
    assert parse_duration(text) == expected


def test_bad_durations():
    for bad in ("", "m", "5", "5x", "1h junk"):
        with pytest.raises(ValueError):
            parse_duration(bad)
    with pytest.raises(TypeError):
        parse_duration(5)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_buckets_in_any_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        one = spark.sql("select timestamp_ntz'2024-03-10 02:37:11.123456' as t, timestamp_ntz'1969-12-31 23:59:59.999999' as old")
        b = lambda d, c="t": bucket_start(F.col(c), parse_duration(d)).alias(d + c)
        text = lambda c: c.cast("string")
        got = one.select(*(text(b(d)) for d in ("15m", "1h", "1d", "1w", "1mo", "1q", "1y")), text(b("1d", "old")), to_micros(F.col("old")), text(from_micros(to_micros(F.col("t")))), text(shifted(F.col("t"), parse_duration("1mo")))).first()
        assert tuple(got) == ("2024-03-10 02:30:00", "2024-03-10 02:00:00", "2024-03-10 00:00:00", "2024-03-04 00:00:00", "2024-03-01 00:00:00", "2024-01-01 00:00:00", "2024-01-01 00:00:00", "1969-12-31 00:00:00", -1, "2024-03-10 02:37:11.123456", "2024-04-10 02:37:11.123456")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_columns(spark):
    df = spark.createDataFrame([(" ab ",), ("  ",), (None,)], "s string")
    assert [r[0] for r in df.select(tidy_symbol("s")).collect()] == ["AB", None, None]
    assert fresh("x", ["X", "x_"]) == "x__"
    with pytest.raises(ValueError, match="nope"):
        require(df, "nope")
