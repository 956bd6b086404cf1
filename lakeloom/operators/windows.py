"""Moving aggregates, the top rows of groups and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def moving_average(df: DataFrame, by: list[str], order: list[str], value: str, before: int, after: int, name: str = "moving_avg") -> DataFrame:
    """The mean over rows from ``before`` rows before to ``after`` rows after, and the deviation from it."""
    mean = F.avg(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(-before, after))
    return df.withColumn(name, mean).withColumn("deviation", F.col(value) - F.col(name))


def top_rows(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k rows of a group in each task before the shuffle."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", n).where(F.col("rank") <= k)


def sessions(df: DataFrame, by: list[str], time: str, gap_seconds: int) -> DataFrame:
    """Adds the number of the session within its keys: a new one begins after a gap longer than gap_seconds."""
    w = W.partitionBy(*by).orderBy(time)
    since = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))
    begins = F.when(since.isNull() | (since > gap_seconds * 1_000_000), 1).otherwise(0)
    return df.withColumn("_begins", begins).withColumn("session", F.sum("_begins").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_begins")


def bucket(time: Column, millis: int) -> Column:
    """The number of the whole bucket of a time in milliseconds; negative times round down too."""
    return F.floor(time / millis)
