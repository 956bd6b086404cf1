import time

import pytest

from lakeloom import runtime
from lakeloom.errors import LakeError, MemoryExceededError, SchemaError, TaskAbandonedError, TaskTimeoutError
from lakeloom.sources.storage import HadoopStorage, LocalStorage
from lakeloom.types import spark_schema, spark_type


def test_bands():
    assert [runtime.regulation(t) for t in (0, 0.29, 0.3, 0.7, 0.71, 0.85, 0.9, 0.95, 0.96)] == ["cold", "cold", "ideal", "ideal", "warm", "warm", "hot", "hot", "critical"]
    assert runtime.temperature(1, 1, 9) == 1.0 and runtime.temperature(0.5, 0, 0) == 0.2


def test_abandonment():
    tracker = runtime.Abandonment()
    tracker.failed("t")
    tracker.failed("t")
    with pytest.raises(TaskAbandonedError):
        tracker.failed("t")
    tracker.succeeded("t")
    tracker.failed("t")


def test_memory_budget():
    budget = runtime.MemoryBudget("bee-0", 10)
    budget.request(10)
    with pytest.raises(MemoryExceededError):
        budget.request(1)
    budget.release(5)
    budget.request(5)


def test_timeout(spark):
    pool = runtime.Pool(spark, 2, timeout_s=60.0)
    assert pool.run(lambda: spark.range(5).count()) == 5
    pool.timeout_s = 0.5
    with pytest.raises(TaskTimeoutError):
        pool.run(lambda: time.sleep(3))
    pool.close()


def test_heartbeats(tmp_path):
    storage = LocalStorage(str(tmp_path))
    heart = runtime.Heartbeat(storage, "a", lambda: {"bees": 2})
    heart.write()
    now = time.time()
    assert [heart.world(now + s)[0]["state"] for s in (0, 14, 20, 40)] == ["alive", "alive", "suspect", "dead"]
    storage.put("_heartbeats/node_x.json", b"{")
    assert len(heart.world()) == 1
    heart.close()
    assert heart.world() == []


def test_types():
    assert spark_type("INT64").simpleString() == "bigint" and spark_type("date32").simpleString() == "date"
    with pytest.raises(SchemaError):
        spark_type("nonsense")
    assert spark_type("nonsense", strict=False).simpleString() == "string"
    for bad in ([], "x", {"fields": [1]}):
        with pytest.raises(SchemaError):
            spark_schema(bad)


def test_hadoop_storage(spark, tmp_path):
    storage = HadoopStorage(spark, f"file://{tmp_path}")
    storage.put_if_not_exists("a/b", b"\x00\xff")
    with pytest.raises(LakeError):
        storage.put_if_not_exists("a/b", b"2")
    assert (storage.get("a/b"), storage.list("a"), storage.exists("a/c")) == (b"\x00\xff", ["a/b"], False)
    storage.delete("a/b")
    with pytest.raises(LakeError):
        storage.get("a/b")
