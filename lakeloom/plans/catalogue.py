"""All relational queries by name: how Spark runs them and what DuckDB runs to check them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.aliases import with_aliases
from ..operators import joins, windows
from . import lake_queries, not_in, sensor, ssb, surface, tpch

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


_schemas: dict[str, StructType] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its schema is read from the files once, as each reading is a Spark job."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def register(spark: SparkSession, sf_dir: str, text: str) -> None:
    """The tables that a text names, as views."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            _table(spark, sf_dir, name).createOrReplaceTempView(name)


def sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, text)
        return spark.sql(not_in.by_key(spark, with_aliases(text)))

    return run


def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    purchases = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.where("event_type = 'view'").select("user_id", "ts", "value")
    return joins.asof_join(purchases, views, ["user_id"], "ts", ["value"], "view_", F.col("ts").cast("date")).drop("ts")


ASOF = """SELECT p.event_id, p.user_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts"""


def in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_size")
    ranges = _table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 2).alias("low"), (F.col("n_nationkey") * 2 + 5).alias("high"))
    return joins.range_join(parts, ranges, "p_size", "low", "high", 5).select("p_partkey", "n_nationkey")


RANGE = "SELECT p_partkey, n_nationkey FROM part JOIN nation ON p_size >= n_nationkey * 2 AND p_size < n_nationkey * 2 + 5"


def salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey"))
    return joins.salted_join(lines, _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"])


SALTED = "SELECT s_suppkey, l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return windows.sessions(events, ["user_id"], "ts", 6 * 3600).select("event_id", F.col("session").cast("long").alias("session"))


SESSIONS = """SELECT event_id, CAST(SUM(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session
FROM (SELECT event_id, user_id, ts, CASE WHEN LAG(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(LAG(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS b
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) AS t"""


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return windows.top_rows(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)


TOP_ORDERS = """SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) AS t WHERE rank <= 2"""

FRAMES = {"join_asof": (asof, ASOF), "join_range": (in_range, RANGE), "join_salted": (salted, SALTED), "win_sessions": (sessions, SESSIONS), "win_top_orders": (top_orders, TOP_ORDERS)}


def everything() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    """The queries over plain tables; the 51 of the three corpora again over frames (lake_...), four
    beside a writer (writing_...), five over cells of several formats (mixed_...)."""
    both = tpch.TPCH | ssb.SSB
    found = {k: (sql_query(t), t) for k, t in (both | surface.BOTH).items()}
    found |= {k: (sql_query(s), d) for k, (s, d) in (sensor.texts() | surface.EACH).items()}
    found |= {f"lake_{k}": (lake_queries.through_frames(t), t) for k, t in both.items()}
    found |= {f"lake_{k}": (lake_queries.through_frames(s), d) for k, (s, d) in sensor.texts().items()}
    found |= {f"writing_{k}": (lake_queries.while_writing(s), d) for k, (s, d) in sensor.texts().items() if k.startswith("ac_")}
    found |= {f"mixed_{k}": (lake_queries.of_mixed_formats(s), d) for k, (s, d) in sensor.texts().items() if k.startswith("fa_")}
    return found | FRAMES | lake_queries.QUERIES
