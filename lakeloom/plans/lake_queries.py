"""Queries that go through frames: written, logged, pruned and read by a lake of their own in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, UnsupportedError
from ..functions import user
from ..ledger import Ledger
from ..sdk import Lake, from_ipc, to_ipc
from ..sources import formats
from ..streaming import sinks
from ..types import type_name

ORDERS = {"o_orderkey": "int64", "o_custkey": "int64", "o_orderstatus": "string", "o_totalprice": "float64", "o_orderdate": "timestamp", "o_orderpriority": "string"}
NATION = {"n_nationkey": "int32", "n_name": "string", "n_regionkey": "int32"}
EVENTS = {"event_id": "int64", "ts": "timestamp", "user_id": "int64", "event_type": "string", "value": "float64", "props": "string"}


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; without spark.checkpoint.dir only a local master has one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="lakeloom-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared.rstrip('/')}/lake-{uuid.uuid4().hex}"


_CORPUS: dict[tuple[str, str], str] = {}
CORPUS_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: Frames that have partitions, so that filters skip cells.
PARTITIONED = {"orders": ["o_orderstatus"], "lineitem": ["l_returnflag"], "customer": ["c_mktsegment"], "events": ["event_type"]}


def fill(lake: Lake, sf_dir: str, names: tuple[str, ...]) -> None:
    lake.create_hive("c")
    lake.create_box("c", "t")
    for name in names:
        rows = lake.spark.read.parquet(f"{sf_dir}/{name}.parquet")
        lake.create_frame("c", "t", name, {f.name: type_name(f.dataType) for f in rows.schema.fields}, PARTITIONED.get(name))
        lake.write_df("c", "t", name, rows)


def corpus(spark: SparkSession, sf_dir: str) -> str:
    """Where a lake has all relational tables as frames; it is written once for each application and folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CORPUS:
        uri = folder(spark)
        with Lake("corpus", uri, spark, timeout_s=3600) as lake:
            fill(lake, sf_dir, CORPUS_TABLES)
        _CORPUS[key] = uri
    return _CORPUS[key]


def enter(lake: Lake) -> None:
    lake.sql_df("USE HIVE c")
    lake.sql_df("USE BOX t")


def through_frames(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A text over bare table names, answered from frames: resolved, pruned by the log's bounds and read as a snapshot."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with Lake("corpus", corpus(spark, sf_dir), spark, timeout_s=3600) as lake:
            enter(lake)
            return lake.sql_df(text)

    return run


def while_writing(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query over a snapshot of events while a thread goes on appending to the frame: what was committed before counts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with Lake("writing", folder(spark), spark, timeout_s=3600) as lake:
            fill(lake, sf_dir, ("events", "customer"))
            enter(lake)
            more = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 97 = 0")
            failed: list[BaseException] = []

            def append() -> None:
                try:
                    for _ in range(3):
                        lake.write_df("c", "t", "events", more)
                except BaseException as error:  # told to the query's thread
                    failed.append(error)

            found = lake.sql_df(text)  # the snapshot of this moment
            writer = threading.Thread(target=append)
            writer.start()
            found.write.parquet(f"{lake.storage.root}/answer")  # runs beside the writer
            writer.join()
            if failed:
                raise failed[0]
            return spark.read.schema(found.schema).parquet(f"{lake.storage.root}/answer")

    return run


def with_lake(call: Callable[[Lake, Callable[[str], DataFrame]], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that gets a lake with hive w and box s, and a reader of the given tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with Lake("queries", folder(spark), spark, timeout_s=3600) as lake:
            lake.create_hive("w")
            lake.create_box("w", "s")
            return call(lake, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    return run


def _nation(lake: Lake, read) -> None:
    lake.create_frame("w", "s", "nation", NATION, ["n_regionkey"])
    lake.write_df("w", "s", "nation", read("nation"))


def _orders(lake: Lake, read, by: list[str] | None = None) -> DataFrame:
    lake.create_frame("w", "s", "orders", ORDERS, by)
    return read("orders")


@with_lake
def frame_scan(lake, read):
    _nation(lake, read)
    return lake.sql_df("SELECT * FROM w.s.nation")


@with_lake
def frame_empty(lake, read):
    lake.create_frame("w", "s", "nation", NATION)
    return lake.sql_df("SELECT COUNT(*) AS n, MAX(n_name) AS name FROM w.s.nation")


@with_lake
def frame_append(lake, read):
    orders = _orders(lake, read)
    for part in (0, 1):
        lake.write_df("w", "s", "orders", orders.where(F.col("o_orderkey") % 2 == part))
    return lake.sql_df("SELECT o_orderstatus, COUNT(*) AS n, MAX(o_orderdate) AS last_day FROM w.s.orders GROUP BY o_orderstatus")


@with_lake
def frame_overwrite(lake, read):
    orders = _orders(lake, read)
    lake.write_df("w", "s", "orders", orders)
    lake.write_df("w", "s", "orders", orders.where("o_orderstatus = 'F'"), overwrite=True)
    return lake.sql_df("SELECT o_orderstatus, COUNT(*) AS n FROM w.s.orders GROUP BY o_orderstatus")


@with_lake
def frame_prune(lake, read):
    lake.write_df("w", "s", "orders", _orders(lake, read, ["o_orderstatus"]))
    found = lake.sql_df("SELECT o_orderkey, o_totalprice FROM w.s.orders WHERE o_orderstatus = 'P' AND (o_totalprice > 300000 OR o_custkey < 50)")
    (_, cells, needed), = lake.session.report.relations
    return found.withColumn("skipped", F.lit(needed < cells))


@with_lake
def frame_snapshot(lake, read):
    orders = _orders(lake, read)
    lake.write_df("w", "s", "orders", orders)
    before = lake.sql_df("SELECT COUNT(*) AS before FROM w.s.orders")
    lake.write_df("w", "s", "orders", orders)
    return before.crossJoin(lake.sql_df("SELECT COUNT(*) AS after FROM w.s.orders"))  # one row each


@with_lake
def frame_names(lake, read):
    _nation(lake, read)
    lake.write_df("w", "s", "orders", _orders(lake, read))
    lake.create_frame("w", "s", "region", {"r_regionkey": "int32", "r_name": "string"})
    lake.write_df("w", "s", "region", read("region"))
    lake.sql_df("USE HIVE w")
    lake.sql_df("USE BOX s")
    return lake.sql_df("WITH region AS (SELECT * FROM s.region WHERE r_name <> 'ASIA') SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE NOT EXISTS (SELECT 1 FROM w.s.orders WHERE o_custkey = n_nationkey)")


@with_lake
def frame_describe(lake, read):
    _nation(lake, read)
    return lake.sql_df("DESCRIBE w.s.nation").where("property IN ('partition_by', 'total_rows', 'cells')")


@with_lake
def show_frames(lake, read):
    _nation(lake, read)
    parts = [lake.sql_df(q).toDF("name").withColumn("kind", F.lit(k)) for k, q in (("hive", "SHOW HIVES"), ("box", "SHOW BOXES IN w"), ("frame", "SHOW FRAMES IN w.s"))]
    return parts[0].union(parts[1]).union(parts[2])


@with_lake
def frame_read_filter(lake, read):
    _nation(lake, read)
    return lake.read_df("w", "s", "nation", {"n_regionkey": "2"})


@with_lake
def frame_compaction(lake, read):
    orders = _orders(lake, read)
    for part in range(3):
        lake.write_df("w", "s", "orders", orders.where(F.col("o_orderkey") % 3 == part))
    lake.compact_frame("w", "s", "orders")
    return lake.sql_df("SELECT o_orderpriority, COUNT(*) AS n FROM w.s.orders GROUP BY o_orderpriority")


@with_lake
def frame_stream(lake, read):
    events = read("events")
    lake.create_frame("w", "s", "events", EVENTS, ["event_type"])
    root = lake.storage.root
    events.write.parquet(f"{root}/stream_in")
    stream = lake.spark.readStream.schema(events.schema).parquet(f"{root}/stream_in")
    for _ in range(2):  # the second run finds nothing new
        sinks.stream_to_frame(stream, lake, "w", "s", "events", f"{root}/stream_state", once=True).awaitTermination()
    return lake.sql_df("SELECT event_type, COUNT(*) AS n, MIN(value) AS low, MAX(value) AS high FROM w.s.events GROUP BY event_type")


@with_lake
def frame_checkpoint(lake, read):
    """Rows before and after version 100, read by a ledger that starts from the checkpoint."""
    _nation(lake, read)
    log = Ledger.open(lake.storage, "w/s/nation", "filler")
    while log.version < 103:
        log.add([])
    lake.write_df("w", "s", "nation", read("nation").where("n_regionkey = 1"))
    return lake.sql_df("SELECT n_regionkey, COUNT(*) AS n FROM w.s.nation GROUP BY n_regionkey")


@with_lake
def frame_ipc(lake, read):
    """Rows in by Arrow IPC bytes and out by Arrow IPC bytes."""
    lake.create_table("w", "s", "nation", NATION)
    lake.write_to_frame("w", "s", "nation", to_ipc(read("nation").select(*NATION)))
    return from_ipc(lake.spark, lake.sql("SELECT n_name, n_regionkey FROM w.s.nation WHERE n_nationkey > 3"))


@with_lake
def frame_cell(lake, read):
    """One cell by its id, some columns of it."""
    _nation(lake, read)
    cells = Ledger.open(lake.storage, "w/s/nation", "reader").cells.values()
    (own,) = [c for c in cells if c.partition_values == {"n_regionkey": "3"}]
    return lake.read_cell("w", "s", "nation", own.id, ["n_name", "unknown"])


@with_lake
def sql_blocked(lake, read):
    """Statements that change rows or names are refused, whatever stands before them."""
    _nation(lake, read)
    rows = []
    for text in ("DELETE FROM w.s.nation", "update w.s.nation set n_name = ''", "/* c */ INSERT INTO w.s.nation VALUES (1)", "-- c\nDROP TABLE w.s.nation", "CREATE TABLE t (a INT)", "ALTER TABLE w.s.nation"):
        try:
            lake.sql_df(text)
            rows.append((text.split()[-1], "ran"))
        except UnsupportedError as error:
            rows.append((str(error).split(": ", 1)[-1].split()[0], "refused"))
    return lake.spark.createDataFrame(rows, "word string, answer string").crossJoin(lake.sql_df("SELECT COUNT(*) AS n FROM w.s.nation"))


@with_lake
def frame_schema_errors(lake, read):
    """Writes that a frame refuses leave it as it was."""
    _nation(lake, read)
    refused = 0
    for bad in (read("nation").withColumn("n_regionkey", F.lit(None).cast("int")), read("nation").withColumn("n_nationkey", F.lit("no number"))):
        try:
            lake.write_df("w", "s", "nation", bad)
        except Exception:  # a schema error, or Spark's own for a cast
            refused += 1
    return lake.sql_df("SELECT COUNT(*) AS n FROM w.s.nation").withColumn("refused", F.lit(refused))


@with_lake
def frame_vacuum(lake, read):
    """Files of cells that were replaced go; the rows stay."""
    orders = _orders(lake, read)
    lake.write_df("w", "s", "orders", orders.where("o_orderkey % 2 = 0"))
    lake.write_df("w", "s", "orders", orders, overwrite=True)
    gone = lake.vacuum_frame("w", "s", "orders", older_than_s=-60)
    return lake.sql_df("SELECT o_orderstatus, COUNT(*) AS n FROM w.s.orders GROUP BY o_orderstatus").withColumn("some_gone", F.lit(gone > 0))


def user_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas function in a projection."""
    user.register(spark, "lake_twice", lambda s: s * 2, "double")
    spark.read.parquet(f"{sf_dir}/supplier.parquet").createOrReplaceTempView("lake_suppliers")
    return spark.sql("SELECT s_suppkey, lake_twice(s_acctbal) AS twice FROM lake_suppliers")


def of_mixed_formats(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query over events whose frame has cells of Parquet, CSV and Arrow, a third of the rows each."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with Lake("mixed", folder(spark), spark, timeout_s=3600) as lake:
            fill(lake, sf_dir, ("customer",))
            rows = spark.read.parquet(f"{sf_dir}/events.parquet")
            lake.create_frame("c", "t", "events", {f.name: type_name(f.dataType) for f in rows.schema.fields})
            root, part = lake.storage.root, lambda k: rows.where(F.col("event_id") % 3 == k)
            lake.write_df("c", "t", "events", part(0))
            part(1).write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(f"{root}/csv")
            formats.write_arrow(part(2), f"{root}/arrow")
            lake.add_files("c", "t", "events", [f"{root}/csv"], "csv")
            lake.add_files("c", "t", "events", [f"{root}/arrow"], "arrow")
            enter(lake)
            return lake.sql_df(text)

    return run


def mixed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, root = spark.read.parquet(f"{sf_dir}/supplier.parquet"), folder(spark)
    part = lambda k: suppliers.where(F.col("s_suppkey") % 2 == k)
    part(0).write.parquet(f"{root}/parquet")
    part(1).write.option("header", True).csv(f"{root}/csv")
    return formats.read_mixed(spark, suppliers.schema, [f"{root}/parquet"], [f"{root}/csv"])


QUERIES = {
    "frame_scan": (frame_scan, "SELECT * FROM nation"),
    "frame_empty": (frame_empty, "SELECT COUNT(*) AS n, MAX(n_name) AS name FROM nation WHERE n_nationkey < 0"),
    "frame_append": (frame_append, "SELECT o_orderstatus, COUNT(*) AS n, MAX(o_orderdate) AS last_day FROM orders GROUP BY o_orderstatus"),
    "frame_overwrite": (frame_overwrite, "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderstatus"),
    "frame_prune": (frame_prune, "SELECT o_orderkey, o_totalprice, true AS skipped FROM orders WHERE o_orderstatus = 'P' AND (o_totalprice > 300000 OR o_custkey < 50)"),
    "frame_snapshot": (frame_snapshot, "SELECT COUNT(*) AS before, 2 * COUNT(*) AS after FROM orders"),
    "frame_names": (frame_names, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = n_nationkey)"),
    "frame_describe": (frame_describe, "SELECT 'partition_by' AS property, 'n_regionkey' AS value UNION ALL SELECT 'total_rows', CAST(COUNT(*) AS VARCHAR) FROM nation UNION ALL SELECT 'cells', CAST(COUNT(DISTINCT n_regionkey) AS VARCHAR) FROM nation"),
    "show_frames": (show_frames, "SELECT * FROM (VALUES ('w', 'hive'), ('s', 'box'), ('nation', 'frame')) AS t(name, kind)"),
    "frame_read_filter": (frame_read_filter, "SELECT * FROM nation WHERE n_regionkey = 2"),
    "frame_compaction": (frame_compaction, "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority"),
    "frame_stream": (frame_stream, "SELECT event_type, COUNT(*) AS n, MIN(value) AS low, MAX(value) AS high FROM events GROUP BY event_type"),
    "frame_checkpoint": (frame_checkpoint, "SELECT n_regionkey, COUNT(*) + COUNT(CASE WHEN n_regionkey = 1 THEN 1 END) AS n FROM nation GROUP BY n_regionkey"),
    "frame_ipc": (frame_ipc, "SELECT n_name, n_regionkey FROM nation WHERE n_nationkey > 3"),
    "frame_cell": (frame_cell, "SELECT n_name FROM nation WHERE n_regionkey = 3"),
    "frame_schema_errors": (frame_schema_errors, "SELECT COUNT(*) AS n, 2 AS refused FROM nation"),
    "frame_vacuum": (frame_vacuum, "SELECT o_orderstatus, COUNT(*) AS n, true AS some_gone FROM orders GROUP BY o_orderstatus"),
    "sql_blocked": (sql_blocked, "SELECT word, 'refused' AS answer, n FROM (VALUES ('DELETE'), ('UPDATE'), ('INSERT'), ('DROP'), ('CREATE'), ('ALTER')) AS t(word), (SELECT COUNT(*) AS n FROM nation) AS c"),
    "user_functions": (user_functions, "SELECT s_suppkey, s_acctbal * 2 AS twice FROM supplier"),
    "frame_mixed_formats": (mixed_formats, "SELECT * FROM supplier"),
}
