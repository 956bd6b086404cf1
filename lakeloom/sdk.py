"""The facade: a namespace of frames, rows in and out as Arrow or DataFrames, SQL, and status."""

from __future__ import annotations

import uuid
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .catalog import Catalog
from .errors import ConfigError, LakeError, NotFoundError, SchemaError
from .ledger import Ledger
from .session import get_session
from .sources import frames
from .sources.storage import open_storage
from .sqlapi import SqlSession
from .types import spark_schema


def to_ipc(df: DataFrame) -> bytes:
    """All rows as an Arrow IPC stream: for results that the driver can hold."""
    import pyarrow as pa

    table = df.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def from_ipc(spark: SparkSession, data: bytes) -> DataFrame:
    """Rows of an Arrow IPC stream; types that Spark lacks are widened."""
    import pyarrow as pa

    try:
        table = pa.ipc.open_stream(data).read_all()
    except pa.ArrowInvalid as error:
        raise SchemaError(f"not an Arrow IPC stream: {error}") from None
    wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.float16(): pa.float32()}
    for k, f in enumerate(table.schema):
        if f.type in wider:
            table = table.set_column(k, f.name, table.column(k).cast(wider[f.type]))
    return spark.createDataFrame(table)


class Lake:
    """Namespaces, frames and SQL over one storage root."""

    def __init__(self, name: str, storage: str | None = None, spark: SparkSession | None = None, timeout_s: float = 30.0):
        """``timeout_s`` bounds sql(), which gathers its rows; sql_df() has no bound of its own."""
        self.name, self.uri, self.timeout_s = name, storage, timeout_s
        self._spark, self._parts = spark, None

    # Lifecycle

    def start(self) -> None:
        spark = self._spark or get_session()
        self._spark = spark
        storage = open_storage(spark, self.uri, self.name)
        self.node_id = uuid.uuid4().hex[:12]
        self.cores = spark.sparkContext.defaultParallelism
        catalog = Catalog(storage)
        pool = runtime.Pool(spark, max(1, self.cores), self.timeout_s)
        heart = runtime.Heartbeat(storage, self.node_id, self._facts)
        self._parts = (spark, storage, catalog, SqlSession(spark, storage, catalog, self.node_id), pool, heart)
        heart.start()

    def shutdown(self) -> None:
        if self._parts is not None:
            self.pool.close()
            self._parts[5].close()
            self._parts = None

    def __enter__(self) -> Lake:
        self.start()
        return self

    def __exit__(self, *_) -> None:
        self.shutdown()

    def _part(self, k: int):
        if self._parts is None:
            raise ConfigError("Not started. Call start() first.")
        return self._parts[k]

    spark = property(lambda self: self._part(0))
    storage = property(lambda self: self._part(1))
    catalog = property(lambda self: self._part(2))
    session = property(lambda self: self._part(3))
    pool = property(lambda self: self._part(4))

    # Namespace

    def create_hive(self, name: str) -> None:
        self.catalog.create_hive(name)

    def create_box(self, hive: str, name: str) -> None:
        self.catalog.create_box(hive, name)

    def create_frame(self, hive: str, box_name: str, name: str, schema: Any, partition_by: list[str] | None = None) -> None:
        fields = spark_schema(schema).names
        for p in partition_by or []:
            if p not in fields:
                raise SchemaError(f"Partition column '{p}' is not in the schema")
            if not isinstance(spark_schema(schema)[p].dataType, frames.COUNTED):
                raise SchemaError(f"Partition column '{p}' has a type without an order")
        self.catalog.create_frame(hive, box_name, name, schema, partition_by)
        Ledger.create(self.storage, f"{hive}/{box_name}/{name}", self.node_id, schema, partition_by or [])

    def list_hives(self) -> list[str]:
        return self.catalog.list_hives()

    def list_boxes(self, hive: str) -> list[str]:
        return self.catalog.list_boxes(hive)

    def list_frames(self, hive: str, box_name: str) -> list[str]:
        return self.catalog.list_frames(hive, box_name)

    def get_frame(self, hive: str, box_name: str, name: str) -> dict[str, Any]:
        """Schema, partitioning and limits, and how many cells, rows and bytes there are."""
        spec = self.catalog.get_frame(hive, box_name, name)
        found = {k: spec[k] for k in ("schema", "partition_by", "max_partitions", "created_at")}
        try:
            cells = list(Ledger.open(self.storage, f"{hive}/{box_name}/{name}", self.node_id).cells.values())
        except NotFoundError:
            cells = []
        return found | {"name": name, "cell_count": len(cells), "row_count": sum(c.rows for c in cells), "total_bytes": sum(c.bytes for c in cells)}

    create_database, list_databases = create_hive, list_hives

    def create_schema(self, database: str, name: str) -> None:
        self.create_box(database, name)

    def create_table(self, database: str, schema: str, name: str, columns: Any, partition_by: list[str] | None = None) -> None:
        self.create_frame(database, schema, name, columns, partition_by)

    def list_schemas(self, database: str) -> list[str]:
        return self.list_boxes(database)

    def list_tables(self, database: str, schema: str) -> list[str]:
        return self.list_frames(database, schema)

    def get_table(self, database: str, schema: str, name: str) -> dict[str, Any]:
        return self.get_frame(database, schema, name)

    # Rows

    @property
    def target_cell_size(self) -> int:
        """A quarter of a core's memory, but what a Spark task reads at once at most."""
        return max(16 << 20, min(runtime.memory_bytes() // max(1, self.cores) // 4, 512 << 20))

    def write_df(self, hive: str, box_name: str, frame: str, df: DataFrame, overwrite: bool = False, writer: str | None = None, number: int = 0) -> dict[str, Any]:
        spec = self.catalog.get_frame(hive, box_name, frame)
        done = frames.write(self.spark, self.storage, f"{hive}/{box_name}/{frame}", spec, df, self.node_id, overwrite, self.target_cell_size, writer, number)
        return asdict(done) | {"temperature": self.pool.temperature()}

    def write_to_frame(self, hive: str, box_name: str, frame_name: str, ipc_data: bytes) -> dict[str, Any]:
        return self.write_df(hive, box_name, frame_name, from_ipc(self.spark, ipc_data))

    def overwrite_frame(self, hive: str, box_name: str, frame_name: str, ipc_data: bytes) -> dict[str, Any]:
        return self.write_df(hive, box_name, frame_name, from_ipc(self.spark, ipc_data), overwrite=True)

    def read_df(self, hive: str, box_name: str, frame: str, partition_filter: dict[str, str] | None = None) -> DataFrame | None:
        """A snapshot of a frame, or None where it has no cells. Filters are equalities on partition columns."""
        spec = self.catalog.get_frame(hive, box_name, frame)
        for column in partition_filter or {}:
            if column not in spec["partition_by"]:
                raise SchemaError(f"'{column}' is not a partition column")
        key = f"{hive}/{box_name}/{frame}"
        try:
            cells = list(Ledger.open(self.storage, key, self.node_id).cells.values())
        except NotFoundError:
            return None
        kept = [c for c in cells if all(c.partition_values.get(k) == str(v) for k, v in (partition_filter or {}).items())]
        if not kept:
            return None
        return frames.read_cells(self.spark, self.storage.root, key, spark_schema(spec["schema"]), kept)

    def read_from_frame(self, hive: str, box_name: str, frame_name: str, partition_filter: dict[str, str] | None = None) -> bytes | None:
        found = self.read_df(hive, box_name, frame_name, partition_filter)
        return None if found is None else to_ipc(found)

    def read_cell(self, hive: str, box_name: str, frame: str, cell_id: str, columns: list[str] | None = None) -> DataFrame:
        """One file; columns that it does not have are ignored."""
        spec, key = self.catalog.get_frame(hive, box_name, frame), f"{hive}/{box_name}/{frame}"
        cells = Ledger.open(self.storage, key, self.node_id).cells
        if cell_id not in cells:
            raise NotFoundError(cell_id)
        schema = spark_schema(spec["schema"])
        wanted = [c for c in columns if c in schema.names] if columns is not None else schema.names
        return frames.read_cells(self.spark, self.storage.root, key, schema, [cells[cell_id]]).select(*(F.col(f"`{c}`") for c in wanted))

    def add_files(self, hive: str, box_name: str, frame: str, paths: list[str], kind: str = "parquet") -> dict[str, Any]:
        """Files that are there already (parquet, csv or arrow) as cells of a frame."""
        spec = self.catalog.get_frame(hive, box_name, frame)
        return asdict(frames.add_files(self.spark, self.storage, f"{hive}/{box_name}/{frame}", spec, paths, kind, self.node_id))

    def vacuum_frame(self, hive: str, box_name: str, frame: str, older_than_s: float = 7 * 86400) -> int:
        """Deletes files that no cell names any more; returns how many."""
        self.catalog.get_frame(hive, box_name, frame)
        return frames.vacuum(self.spark, self.storage, f"{hive}/{box_name}/{frame}", self.node_id, older_than_s)

    def compact_frame(self, hive: str, box_name: str, frame: str) -> dict[str, Any]:
        spec = self.catalog.get_frame(hive, box_name, frame)
        return asdict(frames.compact(self.spark, self.storage, f"{hive}/{box_name}/{frame}", spec, self.node_id, self.target_cell_size))

    # SQL

    def sql_df(self, query: str) -> DataFrame:
        """A DataFrame over a snapshot; nothing runs until rows are asked for."""
        return self.session.sql(query)

    def sql(self, query: str) -> bytes | None:
        return self.pool.run(lambda: to_ipc(self.sql_df(query)))

    # Status

    def _facts(self) -> dict[str, Any]:
        if self._parts is None:
            return {"bees": self.cores, "idle_bees": self.cores, "memory_pressure": 0.0, "colony_temperature": 0.0}
        busy, memory, queued = self.pool.load()
        return {"bees": self.cores, "idle_bees": self.cores - round(busy * self.cores), "memory_pressure": memory, "colony_temperature": runtime.temperature(busy, memory, queued)}

    def status(self) -> dict[str, Any]:
        memory = runtime.memory_bytes()
        return {
            "name": self.name, "node_id": self.node_id, "cores": self.cores, "memory_gb": memory / 2**30, "bees": self.cores, "state": "running",
            "storage": "s3" if str(self.storage.root).startswith("s3a://") else "local",
            "memory_per_bee_mb": memory // self.cores >> 20, "target_cell_size_mb": self.target_cell_size >> 20,
        }

    def bee_status(self) -> list[dict[str, Any]]:
        """One row for each core of the cluster."""
        busy, memory, _ = self.pool.load()
        budget = runtime.memory_bytes() // self.cores
        return [{"bee_id": f"bee-{k}", "state": "busy" if k < round(busy * self.cores) else "idle", "memory_used": int(memory * budget), "memory_budget": budget} for k in range(self.cores)]

    def swarm_status(self) -> dict[str, Any]:
        nodes = self._part(5).world()
        keys = ("node_id", "state", "bees", "idle_bees", "memory_pressure", "colony_temperature")
        alive = [n for n in nodes if n["state"] == "alive"]
        return {"nodes": [{k: n.get(k) for k in keys} for n in nodes], "alive": len(alive), "total_bees": sum(n.get("bees", 0) for n in alive), "total_idle_bees": sum(n.get("idle_bees", 0) for n in alive)}

    def colony_status(self) -> dict[str, Any]:
        now = self.pool.temperature()
        return {"temperature": now, "regulation": runtime.regulation(now), "setpoint": runtime.SETPOINT}


__all__ = ["Lake", "LakeError", "from_ipc", "to_ipc"]
