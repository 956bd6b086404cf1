import random

import pytest

from lakeloom.ledger import Cell, ColumnStats
from lakeloom.plans import skipping
from lakeloom.sdk import Lake
from lakeloom.types import spark_schema

SCHEMA = {"p": "string", "a": "int64", "f": "float64", "s": "string", "d": "date", "t": "timestamp", "b": "boolean"}


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    with Lake("t", str(tmp_path_factory.mktemp("lake")), spark) as found:
        found.create_hive("h")
        found.create_box("h", "b")
        found.create_frame("h", "b", "f", SCHEMA, ["p"])
        rng = random.Random(3)
        for p in "xyz":
            rows = []
            for _ in range(30):
                null = lambda v: None if rng.random() < 0.15 else v
                rows.append((p, null(rng.randint(0, 20) + 10 * "xyz".index(p)), null(rng.choice([float("nan"), -0.0, 1.5, 30.0]) if p != "y" else 2.5), null(rng.choice("abc") + p), null(f"2024-0{rng.randint(1, 9)}-11"), null(f"2024-01-0{rng.randint(1, 9)} 01:02:03"), null(rng.random() < 0.5)))
            df = spark.createDataFrame(rows, "p string, a long, f double, s string, d string, t string, b boolean")
            found.write_df("h", "b", "f", df.selectExpr("p", "a", "f", "s", "CAST(d AS DATE) AS d", "CAST(t AS TIMESTAMP_NTZ) AS t", "b"))
        yield found


LEAVES = ["p = 'x'", "p <> 'y'", "p IN ('x', 'z')", "a < 12", "a >= 25", "a = 15", "a IN (1, 40)", "a IN (" + ", ".join(map(str, range(31, 46))) + ")", "p IN (" + ", ".join(f"'{c}'" for c in "abcdefghijklmx") + ")", "d IN (" + ", ".join(f"DATE'2030-01-{k:02d}'" for k in range(1, 15)) + ")", "f > 10", "f = 2.5", "f < 0", "s < 'b'", "s = 'ay'", "s LIKE 'c%'", "d >= '2024-05-01'", "d = DATE'2024-03-11'", "t < '2024-01-04 00:00:00'", "b", "NOT b", "a IS NULL", "a IS NOT NULL", "p = s", "a + 1 > 20", "f IS NULL", "cast(a as string) = '15'"]


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(LEAVES)
    kind = rng.choice(["AND", "OR", "NOT"])
    return f"(NOT {tree(rng, depth - 1)})" if kind == "NOT" else f"({tree(rng, depth - 1)} {kind} {tree(rng, depth - 1)})"


def test_same_rows_as_without(lake):
    rng, skipped = random.Random(5), 0
    everything = lake.read_df("h", "b", "f").cache()
    for where in [*LEAVES, *(tree(rng, 3) for _ in range(25))]:
        expected = everything.where(where).count()
        assert lake.sql_df(f"SELECT * FROM h.b.f WHERE {where}").count() == expected, where
        skipped += lake.session.report.relations[0][2] < 3
    assert skipped >= 10


def test_long_lists_skip(lake):
    assert lake.sql_df("SELECT * FROM h.b.f WHERE p IN (" + ", ".join(f"'{c}'" for c in "abcdefghijklmx") + ")").count() == 30
    assert lake.session.report.relations == [("h.b.f", 3, 1)]


def test_each_place_counts(lake):
    lake.sql_df("SELECT x.a FROM h.b.f x JOIN h.b.f y ON x.a = y.a WHERE x.p = 'x' AND y.p = 'z'")
    assert [r[2] for r in lake.session.report.relations] == [1, 1]
    lake.sql_df("WITH c AS (SELECT * FROM h.b.f) SELECT (SELECT MAX(a) FROM c WHERE p = 'x') AS m, COUNT(*) FROM c WHERE p = 'y'")
    assert lake.session.report.relations[0][2] == 2
    lake.sql_df("SELECT * FROM h.b.f LEFT JOIN (SELECT 1 AS k) o ON f.p = 'x' AND f.a = o.k")
    assert lake.session.report.relations[0][2] == 3


def test_bounds():
    schema = spark_schema({"temp": "float64"})
    cells = [Cell(str(k), "", 2, 1, {}, {"temp": ColumnStats(a, b)}) for k, (a, b) in enumerate([(10.0, 20.0), (30.0, 40.0)])]
    keep = lambda *p: [c.id for c in skipping.needed(cells, [("cmp", "temp", *p)], schema)]
    assert (keep(">=", 25), keep("<", 10.0), keep("<=", 10), keep("=", 35.0), keep(">", 40.0)) == (["1"], [], ["0"], ["1"], [])
    assert skipping.needed(cells, None, schema) == cells
