import threading

import pyarrow as pa
import pytest

from lakeloom.errors import ConfigError, ConflictError, EntityNotFoundError, LakeError, NotFoundError, ResolutionError, SchemaError, UnsupportedError, WriteConflictError
from lakeloom.ledger import Cell, Ledger
from lakeloom.sdk import Lake, from_ipc
from lakeloom.sources.storage import LocalStorage, root_of


def ipc(**columns):
    table = pa.table(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def table(data):
    return pa.ipc.open_stream(data).read_all()


@pytest.fixture
def lake(spark, tmp_path):
    with Lake("t", str(tmp_path / "lake"), spark, timeout_s=300) as found:
        found.create_hive("w")
        found.create_box("w", "s")
        yield found


@pytest.fixture
def stock(lake):
    """Two shops: mill sells three things, quay four dearer ones."""
    lake.create_frame("w", "s", "stock", {"price": "float64", "pieces": "int64", "shop": "string"}, ["shop"])
    lake.write_to_frame("w", "s", "stock", ipc(price=[2.5, 4.0, 8.5], pieces=[7, 9, 20], shop=["mill"] * 3))
    lake.write_to_frame("w", "s", "stock", ipc(price=[12.0, 16.0, 31.0, 41.0], pieces=[1, 2, 4, 300], shop=["quay"] * 4))
    return lake


def test_namespace(lake):
    lake.create_hive("w")  # again: nothing happens
    lake.create_frame("w", "s", "f", {"x": "int64"})
    assert (lake.list_hives(), lake.list_boxes("w"), lake.list_frames("w", "s")) == (["w"], ["s"], ["f"])
    assert lake.get_table("w", "s", "f")["schema"] == {"x": "int64"}
    with pytest.raises(EntityNotFoundError):
        lake.create_box("none", "b")
    with pytest.raises(EntityNotFoundError):
        lake.list_frames("w", "none")
    spec = {"fields": [{"name": "a", "data_type": "Utf8"}, {"name": "b", "type": {"name": "int", "bitWidth": 32, "isSigned": True}}]}
    lake.create_table("w", "s", "g", spec)
    assert lake.get_frame("w", "s", "g")["schema"] == spec
    assert lake.read_from_frame("w", "s", "g") is None
    assert lake.sql_df("SELECT * FROM w.s.g").dtypes == [("a", "string"), ("b", "int")]


def test_not_started():
    with pytest.raises(ConfigError):
        Lake("x").list_hives()


def test_write_read(lake):
    lake.create_frame("w", "s", "f", {"region": "string", "value": "int64"}, ["region"])
    done = lake.write_to_frame("w", "s", "f", ipc(region=["north", "south", "east"], value=[1, 2, 3]))
    assert (done["version"], done["cells_written"], done["rows_written"]) == (1, 3, 3)
    done = lake.write_to_frame("w", "s", "f", ipc(region=["north"], value=[4]))
    assert done["version"] == 2
    rows = table(lake.read_from_frame("w", "s", "f", {"region": "north"})).to_pydict()
    assert sorted(rows["value"]) == [1, 4]
    assert lake.read_from_frame("w", "s", "f", {"region": "west"}) is None
    with pytest.raises(SchemaError):
        lake.read_from_frame("w", "s", "f", {"value": "1"})
    assert lake.overwrite_frame("w", "s", "f", ipc(region=["west"], value=[9]))["version"] == 3
    assert table(lake.read_from_frame("w", "s", "f")).to_pydict() == {"region": ["west"], "value": [9]}
    info = lake.get_frame("w", "s", "f")
    assert (info["cell_count"], info["row_count"]) == (1, 1)


def test_stats_and_cells(lake):
    lake.create_frame("w", "s", "f", {"name": "string", "value": "float64"})
    lake.write_to_frame("w", "s", "f", ipc(name=["alpha", "beta", "gamma"], value=[10.0, 30.0, 20.0]))
    (cell,) = Ledger.open(lake.storage, "w/s/f", "n").cells.values()
    assert (cell.stats["value"].min, cell.stats["value"].max, cell.stats["value"].null_count) == (10.0, 30.0, 0)
    assert lake.read_cell("w", "s", "f", cell.id, ["value", "nothing"]).columns == ["value"]
    lake.write_to_frame("w", "s", "f", ipc(name=["n"], value=[float("nan")]))
    assert lake.sql_df("SELECT name FROM w.s.f WHERE value > 1e9").collect()[0][0] == "n"  # NaN is larger in Spark


def test_conform(lake):
    lake.create_frame("w", "s", "f", {"x": "int32", "y": "string"})
    lake.write_to_frame("w", "s", "f", ipc(extra=[1.5], x=pa.array([7], pa.uint64())))
    assert table(lake.read_from_frame("w", "s", "f")).to_pydict() == {"x": [7], "y": [None]}
    with pytest.raises(Exception, match="(?i)overflow|cast"):
        lake.write_to_frame("w", "s", "f", ipc(x=[1 << 40]))
    with pytest.raises(SchemaError):
        lake.write_to_frame("w", "s", "f", b"nothing of Arrow")


@pytest.mark.parametrize("value", [None, "a/b", "..", "a\\b", "\0"])
def test_bad_partition_values(lake, value):
    lake.create_frame("w", "s", "f", {"region": "string", "value": "float64"}, ["region"])
    with pytest.raises(SchemaError):
        lake.write_to_frame("w", "s", "f", ipc(region=["north", value], value=[1.0, 2.0]))
    assert lake.read_from_frame("w", "s", "f") is None


def test_odd_partition_values(lake):
    lake.create_frame("w", "s", "f", {"region": "string", "value": "int64"}, ["region"])
    names = ["a b", "x=y", "ü", "100%", "01", "1"]
    lake.write_to_frame("w", "s", "f", ipc(region=names, value=list(range(6))))
    for k, name in enumerate(names):
        assert [r.value for r in lake.sql_df(f"SELECT value FROM w.s.f WHERE region = '{name}'").collect()] == [k]
        assert lake.session.report.relations == [("w.s.f", 6, 1)]


def test_max_partitions(lake):
    lake.catalog.create_frame("w", "s", "f", {"p": "int64"}, ["p"], max_partitions=2)
    with pytest.raises(SchemaError):
        lake.write_to_frame("w", "s", "f", ipc(p=[1, 2, 3]))


def test_sql(stock):
    rows = lambda q: [tuple(r.values()) for r in table(stock.sql(q)).to_pylist()]
    assert sorted(rows("SELECT pieces FROM w.s.stock WHERE shop = 'quay'")) == [(1,), (2,), (4,), (300,)]
    assert stock.session.report.relations == [("w.s.stock", 2, 1)]
    assert rows("SELECT COUNT(*) FROM w.s.stock WHERE pieces > 100") == [(1,)]
    assert stock.session.report.relations == [("w.s.stock", 2, 1)]
    assert rows("SELECT shop, SUM(price * pieces) AS worth, MAX(price) FROM w.s.stock GROUP BY shop ORDER BY worth") == [("mill", 223.5, 8.5), ("quay", 12468.0, 41.0)]
    assert rows("SELECT shop, pieces FROM w.s.stock ORDER BY pieces DESC LIMIT 3") == [("quay", 300), ("mill", 20), ("mill", 9)]
    described = dict(rows("DESCRIBE w.s.stock"))
    assert (described["total_rows"], described["cells"], described["partition_by"]) == ("7", "2", "shop")
    assert rows("SHOW HIVES") == [("w",)] and rows("SHOW BOXES IN w;") == [("s",)] and rows("show frames in W.S") == [("stock",)]


def test_names_and_commands(stock):
    sql = lambda q: stock.sql_df(q).collect()
    for q in ("SELECT * FROM stock", "SELECT * FROM s.stock", "SELECT * FROM w.s.none"):
        with pytest.raises(ResolutionError):
            sql(q)
    with pytest.raises(ConfigError):
        sql("USE BOX s")
    with pytest.raises(EntityNotFoundError):
        sql("USE HIVE none")
    assert sql("USE HIVE W")[0].message == "Current hive set to 'w'"
    assert len(sql("SELECT * FROM s.stock")) == 7
    assert sql("use box S;")[0].message == "Current box set to 's'"
    assert len(sql("SELECT stock.price FROM stock WHERE stock.price > 0")) == 7
    for q in ("DESCRIBE stock", "SHOW FRAMES IN w", "SELECT 1"):
        with pytest.raises(ConfigError):
            sql(q)
    for word in ("DELETE FROM x", "update x set a = 1", "INSERT INTO x VALUES (1)", "DROP TABLE x", "-- c\nCREATE TABLE x (a int)", "ALTER TABLE x", "MERGE INTO x"):
        with pytest.raises(UnsupportedError):
            sql(word)


def test_texts_that_confuse_scanners(stock):
    sql = lambda q: stock.sql_df(q).collect()
    q = "WITH stock AS (SELECT shop FROM w.s.stock WHERE price < 5) SELECT COUNT(*) AS n FROM stock"
    assert sql(q)[0].n == 2
    assert sql("SELECT '\U0001f41d FROM w.s.x' AS a, COUNT(*) AS n FROM w.s.stock t, w.s.stock u WHERE t.pieces = u.pieces")[0].n == 7
    assert sql("SELECT EXTRACT(YEAR FROM CAST('2020-01-01' AS DATE)) AS y, SUBSTRING(shop FROM 1 FOR 2) AS p FROM w.s.stock\nWHERE\tprice = 41")[0].p == "qu"
    assert sql("SELECT COUNT(*) AS n FROM w.s.stock WHERE shop = 'mill' OR shop = 'quay'")[0].n == 7
    assert sql("SELECT COUNT(*) AS n FROM w.s.stock WHERE price = 4 AND shop = 'mill' OR pieces = 300")[0].n == 2
    assert sql("SELECT COUNT(*) AS n FROM w.s.stock WHERE NOT shop = 'mill'")[0].n == 4
    assert sql("SELECT COUNT(*) AS n FROM (SELECT * FROM w.s.stock WHERE shop = 'mill' UNION ALL SELECT * FROM w.s.stock) AS u")[0].n == 10
    assert sorted(r[2] for r in stock.session.report.relations) == [1, 2]
    assert sql("SELECT approx_percentile_cont(price, 0.5) AS m FROM w.s.stock")[0].m == 12.0
    assert "reads 1 of 2 cells" in sql("EXPLAIN SELECT * FROM w.s.stock WHERE shop = 'quay'")[0].plan


def test_same_name_in_two_boxes(stock):
    stock.create_box("w", "other")
    stock.create_frame("w", "other", "stock", {"shop": "string", "least": "int64"})
    stock.write_to_frame("w", "other", "stock", ipc(shop=["mill", "quay"], least=[8, 5]))
    q = "SELECT a.pieces FROM w.s.stock a JOIN w.other.stock b ON a.shop = b.shop WHERE a.pieces < b.least"
    assert sorted(r.pieces for r in stock.sql_df(q).collect()) == [1, 2, 4, 7]


def test_snapshot(stock):
    before = stock.sql_df("SELECT * FROM w.s.stock")
    stock.write_to_frame("w", "s", "stock", ipc(price=[0.5, 0.75], pieces=[1, 1], shop=["fair", "mill"]))
    assert (before.count(), stock.sql_df("SELECT * FROM w.s.stock").count()) == (7, 9)


def test_two_nodes_and_threads(lake, spark):
    lake.create_frame("w", "s", "f", {"id": "int64"})
    with Lake("t", lake.uri, spark) as other:
        assert other.swarm_status()["alive"] == 2
        nodes, failed = [lake, other], []

        def add(k):
            try:
                nodes[k % 2].write_to_frame("w", "s", "f", ipc(id=[k]))
            except LakeError as error:
                failed.append(error)

        threads = [threading.Thread(target=add, args=(k,)) for k in range(4)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert not failed
        assert sorted(r.id for r in other.sql_df("SELECT id FROM w.s.f").collect()) == [0, 1, 2, 3]


def test_compaction(lake):
    lake.create_frame("w", "s", "f", {"id": "int64"})
    for k in range(4):
        lake.write_to_frame("w", "s", "f", ipc(id=[k]))
    assert lake.compact_frame("w", "s", "f")["cells_written"] == 1
    assert sorted(r.id for r in lake.read_df("w", "s", "f").collect()) == [0, 1, 2, 3]


def test_ledger_checkpoints(tmp_path):
    storage = LocalStorage(str(tmp_path))
    ledger = Ledger.create(storage, "h/b/f", "n", {"x": "int64"}, [])
    for k in range(101):
        ledger.add([Cell(f"c{k}", f"c{k}.parquet", 1, 1)])
        if k in (99, 100):
            again = Ledger.open(storage, "h/b/f", "n")
            assert (again.version, len(again.cells)) == (k + 1, k + 1)
    assert ledger.replace_all([Cell("z", "z.parquet", 1, 1)]) == 102
    assert list(Ledger.open(storage, "h/b/f", "n").cells) == ["z"]
    with pytest.raises(ConflictError):
        ledger.rewrite(["gone"], [])
    with pytest.raises(NotFoundError):
        Ledger.open(storage, "h/b/none", "n")


def test_batches_once(tmp_path):
    ledger = Ledger.create(LocalStorage(str(tmp_path)), "f", "n", {}, [])
    assert [ledger.add([Cell(f"c{k}", "p", 1, 1)], "w", n) for k, n in enumerate((0, 1, 1, 0, 2))] == [1, 2, 2, 2, 3]


def test_storage(tmp_path):
    storage = LocalStorage(str(tmp_path))
    storage.put_if_not_exists("a/b.json", b"1")
    with pytest.raises(WriteConflictError):
        storage.put_if_not_exists("a/b.json", b"2")
    assert (storage.get("a/b.json"), storage.list("a"), storage.list("none")) == (b"1", ["a/b.json"], [])
    storage.delete("a/b.json")
    with pytest.raises(NotFoundError):
        storage.get("a/b.json")
    with pytest.raises(LakeError):
        storage.put("../x", b"")
    assert root_of("s3://b/p?region=x", "n") == "s3a://b/p" and root_of("local:///x", "n") == "/x"


def test_status(lake):
    assert lake.status()["cores"] == len(lake.bee_status())
    colony = lake.colony_status()
    assert 0 <= colony["temperature"] <= 1 and colony["regulation"] in ("cold", "ideal", "warm", "hot", "critical")


def test_ipc_types(spark):
    df = from_ipc(spark, ipc(a=pa.array([1], pa.uint8()), b=pa.array([1.5], pa.float16()), c=pa.array([2**63], pa.uint64())))
    assert [t for _, t in df.dtypes] == ["smallint", "float", "decimal(20,0)"]
