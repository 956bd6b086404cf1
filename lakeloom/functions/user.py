"""User-defined functions: registered once, called from SQL; Arrow batches unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession, name: str, function: Callable, returns: str) -> None:
    """A function of pandas series, as a scalar function of SQL."""
    spark.udf.register(name, F.pandas_udf(function, returns))


def register_table(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """A class with eval() that yields rows, as a table function of SQL."""
    spark.udtf.register(name, F.udtf(handler, returnType=returns))
