"""Other formats: CSV and Arrow files as DataFrames with a declared schema, and unions of frames kept in several formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, paths: list[str], schema: T.StructType, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").csv(paths)


def read_arrow(spark: SparkSession, paths: list[str], schema: T.StructType, named: bool = False) -> DataFrame:
    """Arrow files (IPC file or stream, also called feather): tasks get paths and read batch by batch. Files that only
    Spark can open come as bytes, up to 2 GB each. ``named`` adds file_path and file_size."""
    remote = any("://" in p and not p.startswith("file://") for p in paths)
    files = spark.read.format("binaryFile").load(paths).select("path", "length", *(["content"] if remote else []))
    extra = [T.StructField("file_path", T.StringType()), T.StructField("file_size", T.LongType())] if named else []
    out = T.StructType([*schema.fields, *extra])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(schema)
        for batch in batches:
            for path, size, *content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                source = pa.BufferReader(content[0]) if content else pa.memory_map("/" + path.removeprefix("file:").lstrip("/"))
                magic = source.read(6)
                source.seek(0)
                opened = pa.ipc.open_file(source) if magic == b"ARROW1" else pa.ipc.open_stream(source)
                some = (opened.get_batch(k) for k in range(opened.num_record_batches)) if magic == b"ARROW1" else opened
                for b in some:
                    for part in pa.Table.from_batches([b]).select(wanted.names).cast(wanted).to_batches(max_chunksize=10_000):
                        more = [pa.array([path] * part.num_rows), pa.array([size] * part.num_rows, pa.int64())] if named else []
                        yield pa.record_batch([*part.columns, *more], names=out.names)

    return files.mapInArrow(run, out)


def write_arrow(df: DataFrame, folder: str) -> None:
    """An Arrow file for each partition, in a folder that driver and executors share. A task that runs again replaces
    its file as a whole."""

    def run(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/part-{TaskContext.get().partitionId():05d}.arrow"
        temporary, writer, rows = f"{path}.{TaskContext.get().taskAttemptId()}", None, 0
        for batch in batches:
            writer = writer or pa.ipc.new_file(temporary, batch.schema)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is not None:
            writer.close()
            os.replace(temporary, path)
        yield pa.record_batch([pa.array([rows])], names=["rows"])

    df.mapInArrow(run, "rows long").write.format("noop").mode("overwrite").save()


def read_mixed(spark: SparkSession, schema: T.StructType, parquet: list[str] = (), csv: list[str] = (), arrow: list[str] = ()) -> DataFrame:
    """One DataFrame over files of several formats."""
    parts = []
    if parquet:
        parts.append(spark.read.schema(schema).parquet(*parquet))
    if csv:
        parts.append(read_csv(spark, list(csv), schema))
    if arrow:
        parts.append(read_arrow(spark, list(arrow), schema))
    if not parts:
        return spark.createDataFrame([], schema)
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found
