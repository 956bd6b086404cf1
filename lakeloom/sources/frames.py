"""Frames as DataFrames: rows conform to the schema, go to Parquet cells by partition, and are read by explicit files."""

from __future__ import annotations

import math
import re
import time
import uuid
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..ledger import Cell, ColumnStats, Ledger
from ..types import spark_schema
from . import formats

#: Partition columns stay in the files; folders are named by copies with this prefix.
PREFIX = "part__"
BAD_VALUE = r"\.\.|/|\\|\x00"
COUNTED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.BooleanType, T.DateType, T.TimestampNTZType, T.DecimalType)


@dataclass(frozen=True)
class WriteResult:
    version: int
    cells_written: int
    rows_written: int
    bytes_written: int
    duration_ms: int
    temperature: float = 0.0


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns in declared order: safe casts are made, missing nullable columns are null, others are dropped.
    Casts that lose values (ANSI mode) fail when the rows are written."""
    names = {c.lower(): c for c in df.columns}
    columns = []
    for f in schema.fields:
        own = f.name if f.name in df.columns else names.get(f.name.lower())
        if own is None and not f.nullable:
            raise SchemaError(f"Missing column '{f.name}'")
        columns.append((F.lit(None) if own is None else F.col(f"`{own}`")).cast(f.dataType).alias(f.name))
    return df.select(*columns)


def check_cells(cells: list[Cell], partition_by: list[str], most: int, there: set[tuple[str, ...]]) -> None:
    """Null or unsafe partition values are errors, and too many partitions: read from the new cells, so that rows are
    made only once."""
    for p in partition_by:
        if any(c.stats[p].null_count for c in cells):
            raise SchemaError(f"Partition column '{p}' contains null values")
        if any(re.search(BAD_VALUE, c.partition_values[p]) for c in cells):
            raise SchemaError(f"Partition column '{p}' contains values with '..', '/', '\\' or NUL")
    if partition_by and len(there | {tuple(c.partition_values[p] for p in partition_by) for c in cells}) > most:
        raise SchemaError(f"more than {most} partitions")


def write_cells(df: DataFrame, root: str, frame: str, partition_by: list[str], target_bytes: int, check=None) -> list[Cell]:
    """Writes rows as LZ4 Parquet files in a new folder of the frame and describes them. If ``check`` refuses the cells,
    the folder goes again.

    Rows of a partition come together, without making one task of a large one: AQE splits and joins partitions to the
    advisory size. Statistics come from one aggregation over the new files.
    """
    spark, folder = df.sparkSession, f"cells_{uuid.uuid4().hex}"
    dealt = df.hint("rebalance", *(F.col(p) for p in partition_by)) if partition_by else df.hint("rebalance")
    row = sum(_width(f.dataType) for f in df.schema.fields)
    writer = dealt.select("*", *(F.translate(F.col(p).cast("string"), "\0", "?").alias(f"{PREFIX}{p}") for p in partition_by)).write.option("compression", "lz4_raw").option("maxRecordsPerFile", max(1, target_bytes // max(row, 1)))
    if partition_by:
        writer = writer.partitionBy(*(f"{PREFIX}{p}" for p in partition_by))
    path = f"{root}/{frame}/{folder}"
    writer.parquet(path)
    cells = describe(spark, path, f"{root}/{frame}", df.schema, partition_by)
    if check is not None:
        try:
            check(cells)
        except SchemaError:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
            raise
    return cells


def _width(t: T.DataType) -> int:
    return {"string": 20, "binary": 20, "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "date": 4, "float": 4}.get(t.simpleString(), 8)


def describe(spark: SparkSession, path: str, base: str, schema: T.StructType, partition_by: list[str]) -> list[Cell]:
    """The Parquet files of a folder as cells with paths below ``base``."""
    if not _has_files(spark, path):
        return []
    return described(spark.read.schema(schema).parquet(path).select("*", "_metadata.file_path", "_metadata.file_size"), base, schema, partition_by)


def described(files: DataFrame, base: str | None, schema: T.StructType, partition_by: list[str], kind: str = "parquet") -> list[Cell]:
    """A cell for each file of rows with file_path and file_size, whose statistics one aggregation finds."""
    fields = [f for f in schema.fields if isinstance(f.dataType, COUNTED)]
    names = [f.name for f in fields]
    aggregates = [F.count("*").alias("rows")]
    for k, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        floats = isinstance(f.dataType, T.FloatType | T.DoubleType)
        aggregates += [F.min(c).alias(f"min{k}"), F.max(c).alias(f"max{k}"), F.count(F.when(c.isNull(), 1)).alias(f"null{k}")]
        aggregates += [F.count(F.when(F.isnan(c), 1)).alias(f"nan{k}")] if floats else []
    cells = []
    for r in files.groupBy("file_path", "file_size").agg(*aggregates).collect():  # a row for each new cell
        own = unquote(r["file_path"])
        own = own[own.index(base) + len(base) + 1 :] if base is not None and base in own else own
        stats = {}
        for k, f in enumerate(fields):
            low, high = _plain(r[f"min{k}"]), _plain(r[f"max{k}"])
            if f"nan{k}" in r and r[f"nan{k}"]:
                low = high = None  # a value that compares with nothing: no bounds
            stats[f.name] = ColumnStats(low, high, r[f"null{k}"])
        # All rows of a cell have the same partition values, which the statistics hold
        values = {p: _text(r[f"min{names.index(p)}"]) for p in partition_by}
        cells.append(Cell(uuid.uuid4().hex, own, r["rows"], r["file_size"], values, stats, kind))
    return sorted(cells, key=lambda c: c.path)


def _has_files(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    fs = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(found):
        return False
    files = fs.listFiles(found, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".parquet"):
            return True
    return False


def _plain(value):
    """A value as JSON keeps it."""
    if value is None or isinstance(value, bool | int | str):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return str(value)


def _text(value) -> str:
    return {True: "true", False: "false"}[value] if isinstance(value, bool) else str(value)


def read_cells(spark: SparkSession, root: str, frame: str, schema: T.StructType, cells: list[Cell]) -> DataFrame:
    """The rows of just these files: a fixed list is a snapshot, whatever is committed later."""
    if not cells:
        return spark.createDataFrame([], schema)
    by_format: dict[str, list[str]] = {}
    for c in cells:
        outside = c.path.startswith(("/", "file:")) or "://" in c.path
        by_format.setdefault(c.format, []).append(c.path if outside else f"{root}/{frame}/{c.path}")
    readers = {"csv": lambda paths: formats.read_csv(spark, paths, schema), "arrow": lambda paths: formats.read_arrow(spark, paths, schema)}
    parquet = lambda paths: spark.read.schema(schema).parquet(*paths)
    parts = [readers.get(kind, parquet)(paths).select(*(F.col(f"`{f.name}`") for f in schema.fields)) for kind, paths in sorted(by_format.items())]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found


def add_files(spark: SparkSession, storage, frame_key: str, spec: dict, paths: list[str], kind: str, node: str) -> WriteResult:
    """Files of Parquet, CSV (with a header) or Arrow that lie elsewhere become cells where they are, with statistics.
    They stay their owner's: vacuum leaves them alone, compaction rewrites their rows. Frames without partitions only."""
    started = time.monotonic()
    if spec["partition_by"]:
        raise SchemaError("files can only be added to frames without partitions")
    schema = spark_schema(spec["schema"])
    if kind == "arrow":
        files = formats.read_arrow(spark, paths, schema, named=True)
    elif kind in ("csv", "parquet"):
        found = formats.read_csv(spark, paths, schema) if kind == "csv" else spark.read.schema(schema).parquet(*paths)
        files = found.select("*", "_metadata.file_path", "_metadata.file_size")
    else:
        raise SchemaError(f"no reader for files of format '{kind}'")
    cells = described(files, None, schema, [], kind)
    version = Ledger.create(storage, frame_key, node, spec["schema"], []).add(cells)
    return WriteResult(version, len(cells), sum(c.rows for c in cells), sum(c.bytes for c in cells), int((time.monotonic() - started) * 1000))


def vacuum(spark: SparkSession, storage, frame_key: str, node: str, older_than_s: float) -> int:
    """Deletes files of the frame's folder that no active cell names and that are older than so many seconds: what
    failed commits, repeated stream batches, overwrites and compactions left. Returns their number. Snapshots taken
    before that age and still read would miss files."""
    jvm = spark.sparkContext._jvm
    base = f"{storage.root}/{frame_key}"
    folder = jvm.org.apache.hadoop.fs.Path(base)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    active = {c.path for c in Ledger.open(storage, frame_key, node).cells.values()}
    last, gone = (time.time() - older_than_s) * 1000, 0
    for status in fs.listStatus(folder):
        if not status.isDirectory() or not status.getPath().getName().startswith("cells_"):
            continue
        files, left = fs.listFiles(status.getPath(), True), 0
        while files.hasNext():
            f = files.next()
            own = f.getPath().toString()
            own = own[own.index(base) + len(base) + 1 :]
            if own in active or f.getModificationTime() > last:
                left += 1
            elif fs.delete(f.getPath(), False):
                gone += f.getPath().getName().endswith(".parquet")
        if not left:
            fs.delete(status.getPath(), True)
    return gone


def write(spark: SparkSession, storage, frame_key: str, spec: dict, df: DataFrame, node: str, overwrite: bool, target_bytes: int, writer: str | None = None, number: int = 0) -> WriteResult:
    started = time.monotonic()
    schema = spark_schema(spec["schema"])
    ledger = Ledger.open(storage, frame_key, node) if overwrite else Ledger.create(storage, frame_key, node, spec["schema"], spec["partition_by"])
    rows = conform(df, schema)
    there = set() if overwrite else {tuple(c.partition_values.get(p, "") for p in spec["partition_by"]) for c in ledger.cells.values()}
    check = lambda cells: check_cells(cells, spec["partition_by"], spec.get("max_partitions", 10_000), there)
    cells = write_cells(rows, storage.root, frame_key, spec["partition_by"], target_bytes, check)
    version = ledger.replace_all(cells) if overwrite else ledger.add(cells, writer, number)
    return WriteResult(version, len(cells), sum(c.rows for c in cells), sum(c.bytes for c in cells), int((time.monotonic() - started) * 1000))


def compact(spark: SparkSession, storage, frame_key: str, spec: dict, node: str, target_bytes: int) -> WriteResult:
    """Rewrites the small cells of a frame (below half of the target) as fewer ones."""
    started = time.monotonic()
    schema = spark_schema(spec["schema"])
    ledger = Ledger.open(storage, frame_key, node)
    small = [c for c in ledger.cells.values() if c.bytes < target_bytes // 2]
    if len(small) < 2:
        return WriteResult(ledger.version, 0, 0, 0, 0)
    cells = write_cells(read_cells(spark, storage.root, frame_key, schema, small), storage.root, frame_key, spec["partition_by"], target_bytes)
    version = ledger.rewrite([c.id for c in small], cells)
    return WriteResult(version, len(cells), sum(c.rows for c in cells), sum(c.bytes for c in cells), int((time.monotonic() - started) * 1000))
