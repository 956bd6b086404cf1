"""The node around a Spark session: admission, timeouts, load, and which other nodes are alive."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from typing import Any, TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

from .errors import LakeError, MemoryExceededError, TaskAbandonedError, TaskTimeoutError

R = TypeVar("R")
BANDS = ((0.3, "cold"), (0.7, "ideal"), (0.85, "warm"), (0.95, "hot"))
SETPOINT, CRITICAL = 0.5, 0.95
HEARTBEAT_S, SUSPECT_S, DEAD_S = 5.0, 15.0, 30.0


def regulation(temperature: float) -> str:
    """Cold below 0.3; the other bands hold their upper end."""
    if temperature < BANDS[0][0]:
        return "cold"
    return next((name for top, name in BANDS[1:] if temperature <= top), "critical")


def temperature(busy: float, memory: float, queued: float) -> float:
    """From shares of busy workers, used memory and the filled queue."""
    return min(1.0, 0.4 * busy + 0.4 * memory + 0.2 * min(1.0, queued))


class Abandonment:
    """Counts failures by task; the third one abandons it."""

    def __init__(self, most: int = 3):
        self.most, self.failures = most, Counter()

    def failed(self, task: str, why: str = "") -> None:
        self.failures[task] += 1
        if self.failures[task] >= self.most:
            raise TaskAbandonedError(f"{task} failed {self.failures[task]} times{': ' + why if why else ''}")

    def succeeded(self, task: str) -> None:
        self.failures.pop(task, None)


class MemoryBudget:
    """Memory that a worker asked for; more than the budget is refused."""

    def __init__(self, worker: str, budget: int):
        self.worker, self.budget, self.used = worker, budget, 0
        self.lock = threading.Lock()

    def request(self, size: int) -> None:
        with self.lock:
            if self.used + size > self.budget:
                raise MemoryExceededError(self.worker, size, self.budget)
            self.used += size

    def release(self, size: int) -> None:
        with self.lock:
            self.used = max(0, self.used - size)


class Pool:
    """Runs calls that start Spark jobs; a call that takes too long has its jobs cancelled."""

    def __init__(self, spark: SparkSession, workers: int, timeout_s: float = 30.0):
        self.spark, self.workers, self.timeout_s = spark, workers, timeout_s
        self.threads = ThreadPoolExecutor(workers)
        self.lock, self.running, self.waiting = threading.Lock(), 0, 0

    def load(self) -> tuple[float, float, float]:
        tracker = self.spark.sparkContext.statusTracker()
        active = sum(info.numActiveTasks for s in tracker.getActiveStageIds() if (info := tracker.getStageInfo(s)))
        cores = max(1, self.spark.sparkContext.defaultParallelism)
        runtime = self.spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
        memory = (runtime.totalMemory() - runtime.freeMemory()) / runtime.maxMemory()
        return min(1.0, max(active / cores, self.running / self.workers)), memory, self.waiting / (2 * self.workers)

    def temperature(self) -> float:
        return temperature(*self.load())

    def run(self, call: Callable[[], R]) -> R:
        if (now := self.temperature()) > CRITICAL:
            raise LakeError(f"too hot ({now:.2f}): no new work until running tasks end")
        tag = f"lake-{uuid.uuid4().hex}"

        def work() -> R:
            with self.lock:
                self.waiting -= 1
                self.running += 1
            self.spark.sparkContext.addJobTag(tag)
            try:
                return call()
            finally:
                self.spark.sparkContext.removeJobTag(tag)
                with self.lock:
                    self.running -= 1

        with self.lock:
            self.waiting += 1
        future = self.threads.submit(inheritable_thread_target(self.spark)(work))
        try:
            return future.result(self.timeout_s)
        except Late:
            if future.cancel():
                with self.lock:
                    self.waiting -= 1
            self.spark.sparkContext.cancelJobsWithTag(tag)
            raise TaskTimeoutError(f"it took more than {self.timeout_s:g} s") from None

    def close(self) -> None:
        self.threads.shutdown(wait=False, cancel_futures=True)


class Heartbeat:
    """Tells other nodes on the same storage that this one is alive, and sees which of them are."""

    def __init__(self, storage, node: str, facts: Callable[[], dict[str, Any]], each_s: float = HEARTBEAT_S):
        self.storage, self.node, self.facts, self.each_s = storage, node, facts, each_s
        self.stop = threading.Event()
        self.thread = threading.Thread(target=self._beat, daemon=True)

    def start(self) -> None:
        self.write()
        self.thread.start()

    def _beat(self) -> None:
        while not self.stop.wait(self.each_s):
            try:
                self.write()
            except Exception:  # a beat that is missed is what the others look for
                continue

    def write(self) -> None:
        self.storage.put(f"_heartbeats/node_{self.node}.json", json.dumps({"node_id": self.node, "time": time.time()} | self.facts()).encode())

    def world(self, at: float | None = None) -> list[dict[str, Any]]:
        at, found = at or time.time(), []
        for key in self.storage.list("_heartbeats"):
            try:
                beat = json.loads(self.storage.get(key))
            except (LakeError, ValueError):
                continue
            age = at - beat["time"]
            found.append(beat | {"state": "dead" if age > DEAD_S else "suspect" if age > SUSPECT_S else "alive"})
        return found

    def close(self) -> None:
        self.stop.set()
        try:
            self.storage.delete(f"_heartbeats/node_{self.node}.json")
        except LakeError:
            pass


def memory_bytes() -> int:
    return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
