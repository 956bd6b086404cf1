"""The 13 star-schema queries: the fact table is lineitem with its orders, the dimensions come from the other tables."""

LINEORDER = """lineorder AS (
  SELECT l_orderkey AS lo_orderkey, o_custkey AS lo_custkey, l_partkey AS lo_partkey, l_suppkey AS lo_suppkey, CAST(o_orderdate AS DATE) AS lo_orderdate,
         CAST(l_quantity AS BIGINT) AS lo_quantity, CAST(ROUND(l_discount * 100) AS BIGINT) AS lo_discount,
         CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS lo_extendedprice,
         CAST(ROUND(l_extendedprice * 100) AS BIGINT) * (100 - CAST(ROUND(l_discount * 100) AS BIGINT)) AS lo_revenue,
         CAST((l_partkey * 13 + l_suppkey * 7) % 1000 AS BIGINT) AS lo_supplycost
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
DATES = """dates AS (
  SELECT d_datekey, CAST(EXTRACT(YEAR FROM d_datekey) AS BIGINT) AS d_year,
         CAST(EXTRACT(YEAR FROM d_datekey) * 100 + EXTRACT(MONTH FROM d_datekey) AS BIGINT) AS d_yearmonthnum,
         CAST(EXTRACT(WEEK FROM d_datekey) AS BIGINT) AS d_weeknuminyear
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d_datekey FROM orders) AS d)"""
_PLACE = """{p}_nation, {p}_region, {p}_nation || '-' || CAST({key} % 10 AS VARCHAR(2)) AS {p}_city
  FROM (SELECT t.*, n_name AS {p}_nation, r_name AS {p}_region FROM {t} t JOIN nation ON {p}_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) AS x)"""
CUSTOMERS = "customers AS (SELECT c_custkey, " + _PLACE.format(p="c", key="c_custkey", t="customer")
SUPPLIERS = "suppliers AS (SELECT s_suppkey, " + _PLACE.format(p="s", key="s_suppkey", t="supplier")
PARTS = """parts AS (
  SELECT p_partkey, 'MFGR#' || CAST(p_partkey % 5 + 1 AS VARCHAR(1)) AS p_mfgr,
         'MFGR#' || CAST(p_partkey % 5 + 1 AS VARCHAR(1)) || CAST(p_partkey % 4 + 1 AS VARCHAR(1)) AS p_category, p_brand FROM part)"""

_D = "JOIN dates ON lo_orderdate = d_datekey"
_C, _S, _P = "JOIN customers ON lo_custkey = c_custkey", "JOIN suppliers ON lo_suppkey = s_suppkey", "JOIN parts ON lo_partkey = p_partkey"


def _flight1(where: str) -> str:
    return f"WITH {LINEORDER}, {DATES} SELECT CAST(SUM(lo_extendedprice * lo_discount) AS BIGINT) AS revenue FROM lineorder {_D} WHERE {where}"


def _flight2(where: str) -> str:
    return f"""WITH {LINEORDER}, {DATES}, {PARTS}, {SUPPLIERS}
SELECT CAST(SUM(lo_revenue) AS BIGINT) AS lo_revenue, d_year, p_brand FROM lineorder {_D} {_P} {_S}
WHERE {where} GROUP BY d_year, p_brand ORDER BY d_year, p_brand"""


def _flight3(place: str, where: str) -> str:
    return f"""WITH {LINEORDER}, {DATES}, {CUSTOMERS}, {SUPPLIERS}
SELECT c_{place}, s_{place}, d_year, CAST(SUM(lo_revenue) AS BIGINT) AS lo_revenue FROM lineorder {_D} {_C} {_S}
WHERE {where} GROUP BY c_{place}, s_{place}, d_year ORDER BY d_year ASC, lo_revenue DESC"""


def _flight4(keys: str, where: str) -> str:
    return f"""WITH {LINEORDER}, {DATES}, {CUSTOMERS}, {SUPPLIERS}, {PARTS}
SELECT {keys}, CAST(SUM(lo_revenue - lo_supplycost) AS BIGINT) AS profit FROM lineorder {_D} {_C} {_S} {_P}
WHERE {where} GROUP BY {keys} ORDER BY {keys}"""


_CITIES = "(c_city = 'NATION_3-1' OR c_city = 'NATION_3-5') AND (s_city = 'NATION_3-1' OR s_city = 'NATION_3-5')"
SSB: dict[str, str] = {
    "ssb_q1_1": _flight1("d_year = 1996 AND lo_discount BETWEEN 1 AND 3 AND lo_quantity < 25"),
    "ssb_q1_2": _flight1("d_yearmonthnum = 199701 AND lo_discount BETWEEN 4 AND 6 AND lo_quantity BETWEEN 26 AND 35"),
    "ssb_q1_3": _flight1("d_weeknuminyear = 6 AND d_year = 1997 AND lo_discount BETWEEN 5 AND 7 AND lo_quantity BETWEEN 26 AND 35"),
    "ssb_q2_1": _flight2("p_category = 'MFGR#12' AND s_region = 'AMERICA'"),
    "ssb_q2_2": _flight2("p_brand BETWEEN 'Brand#20' AND 'Brand#23' AND s_region = 'ASIA'"),
    "ssb_q2_3": _flight2("p_brand = 'Brand#9' AND s_region = 'EUROPE'"),
    "ssb_q3_1": _flight3("nation", "c_region = 'ASIA' AND s_region = 'ASIA' AND d_year >= 1995 AND d_year <= 1998"),
    "ssb_q3_2": _flight3("city", "c_nation = 'NATION_3' AND s_nation = 'NATION_3' AND d_year >= 1995 AND d_year <= 1998"),
    "ssb_q3_3": _flight3("city", f"{_CITIES} AND d_year >= 1995 AND d_year <= 1999"),
    "ssb_q3_4": _flight3("city", f"{_CITIES} AND d_yearmonthnum BETWEEN 199710 AND 199712"),
    "ssb_q4_1": _flight4("d_year, c_nation", "c_region = 'AMERICA' AND s_region = 'AMERICA' AND (p_mfgr = 'MFGR#1' OR p_mfgr = 'MFGR#2')"),
    "ssb_q4_2": _flight4("d_year, s_nation, p_category", "c_region = 'AMERICA' AND s_region = 'AMERICA' AND (d_year = 1997 OR d_year = 1998) AND (p_mfgr = 'MFGR#1' OR p_mfgr = 'MFGR#2')"),
    "ssb_q4_3": _flight4("d_year, s_city, p_brand", "c_region = 'AMERICA' AND s_region = 'ASIA' AND (d_year = 1997 OR d_year = 1998) AND p_category = 'MFGR#14'"),
}
