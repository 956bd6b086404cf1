import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.functions import user
from lakeloom.operators import joins, windows
from lakeloom.sdk import Lake
from lakeloom.sources import formats
from lakeloom.streaming import sinks
from lakeloom.types import spark_schema


def test_asof(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3), (None, 5, 4)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z"), (None, 1, "n")], "k string, t int, v string")
    found = joins.asof_join(left, right, ["k"], "t", ["v"])
    assert {r.id: r.asof_v for r in found.collect()} == {1: "y", 2: None, 3: None, 4: None}


def test_asof_in_cells(spark):
    draw = lambda seed, n: spark.range(n).select(F.when(F.rand(seed) < 0.8, "hot").when(F.rand(seed + 1) < 0.9, "b").alias("k"), F.when(F.rand(seed + 2) < 0.95, F.floor(F.rand(seed + 3) * 60) - 20).alias("t"), F.col("id").alias("v"))
    left, right = draw(1, 300).withColumnRenamed("v", "id"), draw(5, 40)
    whole, cut = (joins.asof_join(left, right, ["k"], "t", ["v"], cell=c) for c in (None, F.floor(F.col("t") / 3)))
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))
    assert cut.where("asof_v is not null").count() > 150 and cut.columns == whole.columns


def test_range_and_salted(spark):
    points = spark.createDataFrame([(x,) for x in (-7, 0, 4, 5, 12)], "x int")
    ranges = spark.createDataFrame([(1, -10, 5), (2, 5, 6), (3, 8, 8)], "r int, low int, high int")
    assert sorted((r.x, r.r) for r in joins.range_join(points, ranges, "x", "low", "high", 4).collect()) == [(-7, 1), (0, 1), (4, 1), (5, 2)]
    left = spark.range(100).select(F.lit(1).alias("k"), "id")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    assert joins.salted_join(left, right, ["k"]).count() == 200
    with pytest.raises(ValueError):
        joins.salted_join(left, right, ["k"], how="full")
    small = spark.range(2).select(F.lit(1).alias("r"), F.col("id").alias("v"))
    assert joins.small_enough(small) and not joins.small_enough(right)  # nothing is known of the size of Python rows
    assert joins.star_join(left, [(small, F.col("k") == F.col("r")), (right.withColumnRenamed("k", "s"), F.col("k") == F.col("s"))]).count() == 400


def test_windows(spark):
    df = spark.createDataFrame([("a", k, float(k)) for k in range(5)], "k string, t int, v double")
    assert [r.moving_avg for r in windows.moving_average(df, ["k"], ["t"], "v", 1, 1).orderBy("t").collect()] == [0.5, 1.0, 2.0, 3.0, 3.5]
    assert windows.top_rows(df, ["k"], [F.desc("v")], 2).count() == 2
    assert [r.b for r in spark.createDataFrame([(-1,), (0,), (1000,)], "t long").select(windows.bucket(F.col("t"), 1000).alias("b")).collect()] == [-1, 0, 1]


def test_formats(spark, tmp_path):
    schema = spark_schema({"a": "int64", "b": "string"})
    spark.createDataFrame([(1, "p")], schema).write.parquet(str(tmp_path / "p"))
    (tmp_path / "c.csv").write_text("a,b\n2,c\n")
    with pa.ipc.new_file(str(tmp_path / "f.arrow"), pa.schema([("b", pa.string()), ("a", pa.int32())])) as w:
        w.write_table(pa.table({"b": ["f"], "a": pa.array([3], pa.int32())}))
    with pa.ipc.new_stream(str(tmp_path / "s.arrow"), pa.schema([("a", pa.int64()), ("b", pa.string())])) as w:
        w.write_table(pa.table({"a": [4], "b": ["s"]}))
    found = formats.read_mixed(spark, schema, [str(tmp_path / "p")], [str(tmp_path / "c.csv")], [str(tmp_path / "f.arrow"), str(tmp_path / "s.arrow")])
    assert sorted(map(tuple, found.collect())) == [(1, "p"), (2, "c"), (3, "f"), (4, "s")]
    assert formats.read_mixed(spark, schema).count() == 0


def test_user_functions(spark):
    import pandas as pd

    def twice(x: pd.Series) -> pd.Series:
        return x * 2

    class Up:
        def eval(self, n: int):
            for k in range(n):
                yield (k,)

    user.register(spark, "twice", twice, "long")
    user.register_table(spark, "up", Up, "k: int")
    assert [r[0] for r in spark.sql("SELECT twice(k) FROM up(3)").collect()] == [0, 2, 4]


def test_stream_to_frame(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "2024-01-01 00:00:01"), (2, "2024-01-01 00:07:00")], "id long, t string").selectExpr("id", "CAST(t AS TIMESTAMP) AS t").write.parquet(source)
    with Lake("t", str(tmp_path / "lake"), spark) as lake:
        lake.create_hive("h")
        lake.create_box("h", "b")
        lake.create_frame("h", "b", "f", {"id": "int64"})
        stream = spark.readStream.schema("id long, t timestamp").parquet(source)
        for _ in range(2):  # the second run finds nothing new
            sinks.stream_to_frame(stream, lake, "h", "b", "f", str(tmp_path / "cp"), once=True).awaitTermination(60)
        assert sorted(r.id for r in lake.read_df("h", "b", "f").collect()) == [1, 2]
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        q = sinks.windowed(stream, "t", "1 minute", "5 minutes").writeStream.format("memory").queryName("windows").outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert spark.table("windows").count() == 2
