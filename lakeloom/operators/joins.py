"""As-of, range and skewed joins as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], prefix: str = "asof_", cell: Column | None = None) -> DataFrame:
    """Each left row with the values of the last right row with the same keys whose time is not after its own.

    One shuffle of both sides together and one sort; no pair of rows is ever made. Of right rows with one time the
    largest values win. Left rows without a match get nulls; null keys match nothing.

    ``cell``, an expression that never falls as ``on`` rises (the day of a time, say), cuts the rows of a key, so that
    a key with very many rows is sorted in as many tasks as it has cells. What a cell hands on is one row.
    """
    names = [f"{prefix}{v}" for v in values]
    tagged = left.select("*", F.lit(None).cast(_struct(right, values)).alias("_r"), F.lit(1).alias("_side"))
    others = right.select(*by, on, F.struct(*values).alias("_r"), F.lit(0).alias("_side")).where(_all(F.col(k).isNotNull() for k in [*by, on]))
    both = tagged.unionByName(others, allowMissingColumns=True)
    keys = list(by)
    if cell is not None:
        both, keys = both.withColumn("_cell", cell), [*by, "_cell"]
    w = W.partitionBy(*keys).orderBy(F.col(on).asc(), F.col("_side").asc(), F.col("_r").asc()).rowsBetween(W.unboundedPreceding, 0)
    found = both.select("*", F.last("_r", ignorenulls=True).over(w).alias("_found")).where("_side = 1")
    if cell is not None:
        ends = both.groupBy(*keys).agg(F.max(F.when(F.col("_side") == 0, F.struct(on, "_r"))).alias("_end"))
        before = W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
        ends = ends.select(*keys, F.last("_end", ignorenulls=True).over(before)["_r"].alias("_before"))
        found = found.join(ends, keys, "left").withColumn("_found", F.coalesce("_found", "_before"))
    return found.select(*left.columns, *(F.col(f"_found.{v}").alias(n) for v, n in zip(values, names, strict=True)))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Points with the ranges that hold them (low <= point < high), by an equal join on cells of a width.

    A range has a row for each cell that it touches, a point is in one cell: choose the width near the usual range.
    """
    cell = F.floor(F.col(point) / width)
    cells = F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    keyed = ranges.where(F.col(low) < F.col(high)).select("*", cells.alias("_cell"))
    joined = points.select("*", cell.alias("_cell")).join(keyed, ["_cell", *(by or [])])
    return joined.where((F.col(low) <= F.col(point)) & (F.col(point) < F.col(high))).drop("_cell")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int = 16, how: str = "inner", hot: int = 100_000) -> DataFrame:
    """Inner or left join whose large left side may have keys with very many rows. Keys with over ``hot`` left rows are
    spread over ``salts`` tasks, and only their right rows are repeated. A row's salt comes from its values, so that a
    task that runs again deals rows as before."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join cannot do {how}")
    heavy = left.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(*on, F.lit(salts).alias("_salts"))
    one = F.coalesce("_salts", F.lit(1))
    values = F.xxhash64(*(F.col(c) if not isinstance(left.schema[c].dataType, T.MapType) else F.map_entries(c) for c in left.columns))
    salted = left.join(heavy, on, "left").withColumn("_salt", F.pmod(values, one).cast("int")).drop("_salts")
    spread = right.join(heavy, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_salts")
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def small_enough(df: DataFrame, limit: int = 32 << 20) -> bool:
    """Whether the optimizer's estimate of a side's size allows a broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def star_join(fact: DataFrame, dimensions: list[tuple[DataFrame, Column]], limit: int = 32 << 20) -> DataFrame:
    """Joins of a fact table; a dimension is broadcast if it is small enough, else Spark chooses."""
    for dimension, condition in dimensions:
        fact = fact.join(F.broadcast(dimension) if small_enough(dimension, limit) else dimension, condition)
    return fact


def _struct(right: DataFrame, values: list[str]) -> str:
    return right.select(F.struct(*values).alias("r")).schema["r"].dataType.simpleString()


def _all(conditions):
    found = F.lit(True)
    for c in conditions:
        found = found & c
    return found
