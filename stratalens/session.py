"""Session settings shared by the benchmark, the tests and the entry point."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, app: str = "stratalens", partitions: int | None = None) -> SparkSession:
    """A local session tuned as a cluster job would be: AQE on, UTC, Arrow for Python edges."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows over all cores where the input gives fewer tasks than there are cores, as one row group does; else df.

    The partitions are counted without reading a column. An input of many splits is never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df.repartition(cores) if 0 < tasks < cores else df


#: Rows of a task that groups, sorts or joins; a few hundred bytes each in memory.
TASK_ROWS = 300_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of about so many rows, by keys in tasks of TASK_ROWS rows; small frames stay as they are.

    Tasks that are sized by compressed bytes, or a fixed number of them, hold ever more rows as tables grow, until they spill.
    What groups or joins by these keys next takes the rows as they are dealt.
    """
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > 1 else df
