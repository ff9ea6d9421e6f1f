"""Reading the tables and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


MOST_PARTITIONS = 100_000


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where the session has set a checkpoint folder. With a local master,
    whose executors are one machine, a temporary one is made where both are unset; on a cluster that raises ValueError, as executors
    would each write to a disk of their own and parts would be lost."""
    context = spark.sparkContext._jsc.sc()
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir().isDefined():
        if not told and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables are written there")
        spark.sparkContext.setCheckpointDir(told or tempfile.mkdtemp(prefix="tickloom-"))
    return told or context.getCheckpointDir().get()


def stored(df: DataFrame, what: str) -> DataFrame:
    """A written and compressed table in the shared folder, read back; its order is not kept."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and tables that the plan reads. Leaves of unknown size (Catalyst's default for them is the largest long)
    count as 0; sizes above the leaves are not used, as joins are estimated by the product of their sides."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(x for x in sizes if x < 1 << 60)


def partitions_for(df: DataFrame, mb: int = 32) -> int:
    """Partitions of about ``mb`` by that estimate, at least spark.sql.shuffle.partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(MOST_PARTITIONS, -(-input_bytes(df) // (mb << 20))))
