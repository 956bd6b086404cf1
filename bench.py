"""Times the headline queries: one warm-up and the median of three runs of each; one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [f"q{k:02d}" for k in range(1, 23)] + ["ssb_q1_1", "ssb_q2_1", "ssb_q3_1", "ssb_q4_1", "fa_1", "fa_3", "ac_3", "hc_3", "se_1", "group_avg_users", "join_asof"]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def of_frames(spark) -> dict[str, float]:
    """Seconds of appends of 1,000, 10,000 and 50,000 rows (text, number, text) to a frame, and of the mean by text over
    50,000 rows of it: resolved, pruned and read through the log each time."""
    import shutil
    import tempfile

    from pyspark.sql import functions as F

    from lakeloom import Lake

    folder, found = tempfile.mkdtemp(prefix="bench-"), {}
    try:
        with Lake("bench", folder, spark, timeout_s=600) as lake:
            lake.create_hive("b")
            lake.create_box("b", "x")
            for n in (1_000, 10_000, 50_000):
                rows = spark.range(n).select(F.concat(F.lit("u"), F.col("id") * 7919 % 1000).alias("who"), (F.col("id") % 977 / 7).alias("score"), F.col("id").cast("string").alias("at")).cache()
                rows.count()
                each = []
                for k in range(RUNS + 1):
                    lake.create_frame("b", "x", f"f{n}_{k}", {"who": "string", "score": "float64", "at": "string"})
                    started = time.perf_counter()
                    lake.write_df("b", "x", f"f{n}_{k}", rows)
                    each.append(time.perf_counter() - started)
                found[f"append_{n}"] = round(statistics.median(each[1:]), 4)
            each = []
            for _ in range(RUNS + 1):
                started = time.perf_counter()
                lake.sql_df("SELECT who, AVG(score) AS mean FROM b.x.f50000_0 GROUP BY who").write.format("noop").mode("overwrite").save()
                each.append(time.perf_counter() - started)
            found["group_avg_50000"] = round(statistics.median(each[1:]), 4)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return found


def main() -> None:
    from pyspark.sql import SparkSession

    from lakeloom.plans import catalogue

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    everything = catalogue.everything()
    times: dict[str, float] = {}
    for name in HEADLINE:
        run, each = everything[name][0], []
        for k in range(RUNS + 1):
            started = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if k:
                each.append(time.perf_counter() - started)
        times[name] = round(statistics.median(each), 4)
    frames = of_frames(spark)
    duck = {}
    if os.environ.get("BENCH_DUCKDB", "1") == "1":
        import duckdb

        con = duckdb.connect()
        con.execute(f"SET threads = {cpus}")
        for t in catalogue.TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        for name in HEADLINE:
            each = []
            for k in range(RUNS + 1):
                started = time.perf_counter()
                con.execute(everything[name][1]).fetchall()
                if k:
                    each.append(time.perf_counter() - started)
            duck[name] = round(statistics.median(each), 4)
    spark.stop()
    line = {"metric": "sum of median seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "runs": RUNS, "frames": frames}
    print(json.dumps(line | ({"duckdb": duck} if duck else {})))


if __name__ == "__main__":
    main()
