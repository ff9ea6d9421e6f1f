import datetime as dt

from pyspark.sql import functions as F

from tests.conftest import DATA, rows
from tickloom import Config, time_bars
from tickloom.plans.reference_queries import trades
from tickloom.streaming.time_bars import streaming_time_bars


def test_stream_equals_batch(spark, tmp_path):
    t = trades(spark, DATA).drop("event_id")
    t.repartition(3).write.parquet(str(tmp_path / "in"))
    with Config(timestamp_column="ts_event"):
        stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = streaming_time_bars(stream, bar_size="1d", lateness="90 days").writeStream.outputMode("complete").format("memory").queryName("bars").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        same = lambda df: rows(df.withColumn("vwap", F.round("vwap", 6)))
        assert same(spark.table("bars")) == same(time_bars(t, bar_size="1d"))
        week = streaming_time_bars(t, bar_size="1w")
        assert same(week) == same(time_bars(t, bar_size="1w"))
        assert week.select(F.min("ts_event")).first()[0].weekday() == 0


def test_late_rows_are_dropped(spark, tmp_path):
    """Spark drops late rows by the watermark of the batch before, hence the third file."""
    schema = "symbol string, price double, size bigint, timestamp timestamp_ntz"
    at = lambda h: dt.datetime(2024, 1, 1, h)
    for i, part in enumerate([[("A", 1.0, 1, at(1))], [("A", 2.0, 1, at(9))], [("A", 2.0, 1, at(9))], [("A", 3.0, 1, at(1)), ("A", 4.0, 1, at(12))]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = streaming_time_bars(stream, bar_size="1h", lateness="1 hour").writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    first = spark.table("late").where("timestamp = '2024-01-01 01:00:00'").collect()
    assert [(r.volume, r.close) for r in first] == [(1, 1.0)]
