import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from lakeloom import Lake
from lakeloom.functions.aliases import with_aliases
from lakeloom.plans import catalogue, not_in

DATA = "/root/testdata/sf0.001"
ALL = catalogue.everything()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: "~" if pd.isna(v) else (repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v))
    return sorted(tuple(plain(v.item() if hasattr(v, "item") else v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ALL))
def test_matches_duckdb(spark, duck, name):
    run, text = ALL[name]
    ours, theirs = run(spark, DATA).toPandas(), duck.execute(text).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_shuffle_of_small_dimensions(spark):
    plan = ALL["join_chain"][0](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan


def test_filters_reach_the_scan(spark):
    plan = ALL["q06"][0](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_partkey" not in plan


def test_aliases():
    assert with_aliases("SELECT approx_percentile_cont(x, 0.5), 'approx_distinct(' FROM t -- approx_distinct(x)\n") == "SELECT percentile_approx(x, 0.5), 'approx_distinct(' FROM t -- approx_distinct(x)\n"


ODD = {
    "t": "(0, 1), (1, 2), (2, NULL), (NULL, 3), (4, 0), (7, 7)",
    "u": "(0, 5), (2, 2), (2, 3), (9, 4)",
    "w": "(0, 1), (NULL, 2), (2, 3)",
}
NOT_IN = [  # text, and whether Spark's join for NOT IN must be gone
    ("SELECT * FROM t WHERE a NOT IN (SELECT a FROM {q})", True),
    ("SELECT * FROM t WHERE NOT ((a + b)) IN (SELECT a FROM {q}) AND b > 0", True),
    ("SELECT t.a FROM t WHERE (t.a) NOT IN (SELECT CAST(a AS INT) FROM {q} -- )\n) AND b NOT IN (SELECT b FROM u)", True),
    ("SELECT * FROM t WHERE a NOT IN (SELECT a FROM u WHERE b NOT IN (SELECT a FROM {q}))", True),
    ("WITH c AS (SELECT a FROM t WHERE a NOT IN (SELECT a FROM {q})), d AS (SELECT a FROM {q}) SELECT * FROM c WHERE a + 1 NOT IN (SELECT a FROM d)", True),
    ("SELECT 'é' AS z, a FROM t WHERE 'x NOT IN (' <> '' AND a NOT IN (SELECT a FROM {q} UNION SELECT b FROM u)", True),
    ("SELECT * FROM t AS x WHERE x.a NOT IN (SELECT x.a FROM {q} AS x)", True),
    ("SELECT * FROM (SELECT a AS lake_in, b FROM t) AS s WHERE lake_in NOT IN (SELECT CAST(a AS DOUBLE) FROM {q})", True),
    ("SELECT * FROM t WHERE a NOT IN (SELECT a FROM {q} WHERE {q}.b = t.b)", False),
    ("SELECT * FROM t WHERE a NOT IN (SELECT a FROM {q}) OR b = 7", False),
    ("SELECT * FROM t WHERE NOT (a NOT IN (SELECT a FROM {q}))", False),
    ("SELECT a, COUNT(*) AS n FROM t GROUP BY a HAVING COUNT(*) NOT IN (SELECT a FROM {q})", False),
    ("SELECT * FROM t WHERE a NOT IN (SELECT a FROM {q} WHERE a IS NOT NULL ORDER BY a LIMIT 1)", False),
    ("SELECT * FROM t WHERE (a, b) NOT IN (SELECT a, b FROM {q})", False),
]


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
@pytest.mark.parametrize("text, gone", NOT_IN)
def test_not_in_by_key(spark, text, gone, threshold):
    own, con = spark.newSession(), duckdb.connect()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for name, values in (ODD | {"e": "(1, 1)"}).items():  # e has no rows
        view = f"SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM (VALUES {values}) AS v(a, b) WHERE '{name}' <> 'e'"
        con.execute(f"CREATE VIEW {name} AS {view}")
        own.sql(view).createOrReplaceTempView(name)
    for q in "uwe" if threshold == "-1" else "w":
        sql = text.format(q=q)
        found = own.sql(not_in.by_key(own, sql))
        assert rows(found.toPandas()) == rows(con.execute(sql).df())
        if gone and threshold == "-1":  # Spark broadcasts for NOT IN at any size
            plan = found._jdf.queryExecution().sparkPlan().toString()
            assert "Broadcast" not in plan


def test_not_in_of_a_large_query(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for name in ("sub_not_in_null_aware", "sub_not_in_with_null"):
        assert "Broadcast" not in ALL[name][0](own, DATA)._jdf.queryExecution().sparkPlan().toString()


def test_not_in_over_frames(spark, tmp_path):
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    with Lake("not_in", str(tmp_path), own) as lake:
        lake.create_hive("h")
        lake.create_box("h", "b")
        for name, values in ODD.items():
            lake.create_frame("h", "b", name, {"a": "int64", "b": "int64"})
            lake.write_df("h", "b", name, own.sql(f"SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM (VALUES {values}) AS v(a, b)"))
        found = lake.sql_df("SELECT a FROM h.b.t WHERE a NOT IN (SELECT a FROM h.b.u)")
        assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
        assert sorted(r.a for r in found.collect()) == [1, 4, 7]
        assert lake.sql_df("SELECT a FROM h.b.t WHERE a NOT IN (SELECT a FROM h.b.w)").count() == 0


def test_approx_distinct_is_near(spark):
    found = spark.sql(with_aliases("SELECT g, approx_distinct(id * 40 + g) AS n FROM (SELECT id, EXPLODE(SEQUENCE(0, 39)) AS g FROM RANGE(20000)) GROUP BY g")).collect()
    assert len(found) == 40 and max(abs(r.n - 20000) for r in found) < 800  # five times the standard error


def test_approx_distinct_of_few(spark):
    spark.range(300).selectExpr(
        "id", "id % 3 AS g", "CAST(id % 100 AS STRING) AS s", "CAST(id % 7 AS DOUBLE) AS d", "IF(id % 5 = 0, NULL, id % 9) AS n", "ARRAY(id % 4) AS a", "NAMED_STRUCT('x', id % 6) AS st", "IF(id % 2 = 0, '', 'x') AS e"
    ).createOrReplaceTempView("few")
    of = lambda text: [tuple(r) for r in spark.sql(with_aliases(text)).collect()]
    assert of("SELECT approx_distinct(id), Approx_Distinct (s), approx_distinct(d), approx_distinct(n), approx_distinct(a), approx_distinct(st), approx_distinct(e), approx_distinct(DISTINCT id % 10) FROM few") == [(300, 100, 7, 9, 4, 6, 2, 10)]
    assert of("SELECT g, approx_distinct(id) /* ( */ FILTER (WHERE id < 30), approx_distinct(CONCAT(s, ',', ')')), approx_distinct(s) - COUNT(DISTINCT s) FROM few GROUP BY g ORDER BY g") == [(g, 10, 100, 0) for g in range(3)]
    assert of("SELECT DISTINCT approx_distinct(s) OVER (PARTITION BY g), approx_distinct(id % 20) OVER w FROM few WINDOW w AS (PARTITION BY g)") == [(100, 20)]
    assert of("SELECT approx_distinct(id -- it's ), a\n) FILTER (WHERE id < (SELECT approx_distinct(s) FROM few)), 'approx_distinct(x)' FROM few") == [(100, "approx_distinct(x)")]
    assert of("SELECT approx_distinct(id), approx_distinct(CAST(NULL AS INT)) FROM few WHERE id < 0") == [(0, 0)]
    assert with_aliases("SELECT approx_distinct(id, 0.2) FROM few") == "SELECT approx_count_distinct(id, 0.2) FROM few"
