"""What several operators of this folder share: tables, cut lineage, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from typing import ClassVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..session import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of most operators: bytes.split() without arguments cuts at just these characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, UPPER, LOWER)


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset and there are no other machines
    (tests), a temporary folder for each application."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ConfigError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="lakeloom-")
        atexit.register(shutil.rmtree, _OWN[context.applicationId], ignore_errors=True)
    return _OWN[context.applicationId]


#: Rows that go to a Python worker at a time where the session says nothing else: texts are long.
BATCH, DEFAULT_BATCH, BATCH_CONF = 2_000, "10000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with a function of this package, which the executors get if they lack it. Batches are small, and a
    worker gives free memory back after each task: it waits beside an executor of a bounded size."""
    ship(df.sparkSession)
    if df.sparkSession.conf.get(BATCH_CONF) == DEFAULT_BATCH:
        df.sparkSession.conf.set(BATCH_CONF, str(BATCH))

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


class Saved:
    """Tables written to the shared folder, to cut lineage; those no longer needed can be dropped early."""

    #: All that were made in this process and not dropped as a whole.
    made: ClassVar[list[Saved]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        Saved.made.append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.names.discard(name)

    def result(self, df: DataFrame) -> DataFrame:
        """The rows of df as a table; the others, which it was made of, go."""
        kept = self.put(df, "result")
        for name in sorted(self.names - {"result"}):
            self.drop(name)
        return kept


@contextmanager
def swept():
    """Tables that are saved inside go at the end."""
    before = len(Saved.made)
    yield
    for saved in Saved.made[before:]:
        for name in sorted(saved.names):
            saved.drop(name)
    del Saved.made[before:]


def components(links: DataFrame, saved: Saved, name: str = "cc") -> DataFrame:
    """Rows (node, root) for links (a, b): root is the smallest node that can be reached. Nodes without a link are left out.

    Alternating large and small stars: every node is tied to the smallest neighbour it knows, so that a path shortens
    by a constant factor each round. Only minima are gathered, so a node with very many neighbours is no burden.
    """
    now = saved.put(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}0")
    before, k = None, 0
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each node's smaller neighbours and the node itself meet at the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        small = small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct()
        k += 1
        then = saved.put(small, f"{name}{k}")
        state = then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        saved.drop(f"{name}{k - 1}")
        now = then
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
        before = state


def utf8(column) -> list[bytes]:
    """The values of an Arrow string column as bytes; null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(batch, text: int, most: int = 8_000_000) -> Iterable[tuple[int, int, list[bytes]]]:
    """(first row, end row, texts) of parts of an Arrow batch with about ``most`` bytes of text each."""
    first = 0
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    while first < batch.num_rows:
        start = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, start + most, side="right")))
        yield first, end, utf8(batch.column(text).slice(first, end - first))
        first = end
