"""A query for each operator of the SQL surface: projection, predicates, joins, aggregates, windows, sorts, sets, scalars."""

#: Texts that both engines run.
BOTH: dict[str, str] = {
    "proj_star": "SELECT * FROM nation",
    "proj_alias": "SELECT n_nationkey AS id, n_name AS name FROM nation",
    "proj_computed": "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount) + 1, 4) AS net, ROUND((l_quantity - 1) / 4, 6) AS q FROM lineitem",
    "pred_compare": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 400000 AND o_orderstatus <> 'F' AND o_custkey < 1000 AND o_custkey > 10 AND o_totalprice <= 450000",
    "pred_column_column": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount < l_tax",
    "pred_between_numeric": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20",
    "pred_between_string": "SELECT p_partkey, p_brand FROM part WHERE p_brand BETWEEN 'Brand#12' AND 'Brand#14'",
    "pred_in_list": "SELECT p_partkey, p_type FROM part WHERE p_type IN ('PROMO', 'SMALL')",
    "pred_not_in_list": "SELECT p_partkey, p_type FROM part WHERE p_type NOT IN ('PROMO', 'SMALL')",
    "pred_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%' OR p_name LIKE '%ring'",
    "pred_not_like": "SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%a%'",
    "pred_and_or_nested": "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR (o_orderpriority = '1-URGENT' AND o_totalprice > 300000)) AND NOT (o_custkey BETWEEN 100 AND 200)",
    "pred_is_null": "SELECT c_custkey, c_name FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 480000 WHERE o_orderkey IS NULL",
    "expr_case": "SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 300000 THEN 'middle' ELSE 'large' END AS class FROM orders",
    "expr_date_literal": "SELECT COUNT(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02'",
    "sub_from": "SELECT seg, n FROM (SELECT c_mktsegment AS seg, COUNT(*) AS n FROM customer GROUP BY c_mktsegment) AS s WHERE n > 10",
    "sub_cte": "WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT b.o_custkey, b.n FROM big b WHERE b.n >= (SELECT AVG(n) FROM big)",
    "sub_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    "sub_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "sub_in": "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_discount = 0.1 AND l_quantity > 45)",
    "sub_not_in_null_aware": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT CASE WHEN l_quantity > 49 THEN l_partkey ELSE 0 END FROM lineitem)",
    "sub_not_in_with_null": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT CASE WHEN l_quantity > 49 THEN l_partkey END FROM lineitem)",
    "sub_scalar": "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) * 1.5 FROM customer)",
    "sub_scalar_correlated": "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_multi_key": "SELECT a.l_orderkey, a.l_linenumber, b.n FROM lineitem a JOIN (SELECT l_partkey, l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey",
    "join_chain": "SELECT r_name, COUNT(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name",
    "join_self": "SELECT n1.n_name AS a, n2.n_name AS b FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey WHERE n1.n_nationkey < n2.n_nationkey",
    "join_residual": "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE s_suppkey % 10 = c_custkey % 10",
    "join_left_extra_on": "SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'O' GROUP BY c_custkey",
    "join_right": "SELECT n_name, COALESCE(s_suppkey, -1) AS s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey",
    "join_full": "SELECT COALESCE(a.c_nationkey, -1) AS a, COALESCE(b.s_nationkey, -1) AS b, COALESCE(n, 0) AS n, COALESCE(m, 0) AS m FROM (SELECT c_nationkey, COUNT(*) AS n FROM customer WHERE c_acctbal > 9500 GROUP BY c_nationkey) a FULL OUTER JOIN (SELECT s_nationkey, COUNT(*) AS m FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) b ON a.c_nationkey = b.s_nationkey",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_comma": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey",
    "join_semi_inequality": "SELECT l_orderkey, l_linenumber FROM lineitem l1 WHERE EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)",
    "join_anti_inequality": "SELECT l_orderkey, l_linenumber FROM lineitem l1 WHERE NOT EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_quantity > l1.l_quantity)",
    "join_theta_arms": "SELECT c_mktsegment, CAST(SUM(CASE WHEN o_totalprice > c_acctbal * 40 THEN 1 ELSE 0 END) AS BIGINT) AS over_limit FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "agg_counts": "SELECT COUNT(*) AS rows, COUNT(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    "agg_basic": "SELECT event_type, ROUND(SUM(value), 2) AS total, ROUND(AVG(value), 6) AS mean, MIN(value) AS low, MAX(value) AS high FROM events GROUP BY event_type",
    "agg_ratio": "SELECT l_returnflag, ROUND(SUM(l_extendedprice * l_discount) / SUM(l_extendedprice), 9) AS share FROM lineitem GROUP BY l_returnflag",
    "agg_count_distinct": "SELECT COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem",
    "agg_stddev": "SELECT event_type, ROUND(STDDEV(value), 6) AS sd FROM events GROUP BY event_type",
    "agg_conditional": "SELECT o_custkey, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, COUNT(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders GROUP BY o_custkey",
    "agg_group_expression": "SELECT l_quantity - 10 AS q, COUNT(*) AS n FROM lineitem GROUP BY l_quantity - 10",
    "agg_group_alias": "SELECT CAST(FLOOR(p_size / 10) AS BIGINT) AS size_class, COUNT(*) AS n FROM part GROUP BY size_class",
    "agg_global": "SELECT COUNT(*) AS n, MIN(o_orderdate) AS first_day, MAX(o_orderdate) AS last_day FROM orders",
    "agg_global_empty": "SELECT COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders WHERE o_orderkey < 0",
    "agg_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15",
    "agg_having_scalar": "SELECT l_suppkey, SUM(l_quantity) AS q FROM lineitem GROUP BY l_suppkey HAVING SUM(l_quantity) > (SELECT SUM(l_quantity) * 0.011 FROM lineitem)",
    "agg_nested": "SELECT n, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) AS c GROUP BY n",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "agg_distinct_rows": "SELECT DISTINCT p_brand, p_type FROM part",
    "win_moving_sum": "SELECT event_id, SUM(CAST(ROUND(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) / 1 AS cents FROM events",
    "win_ranks": "SELECT c_custkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n, RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS r, DENSE_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS d FROM customer",
    "win_ntile": "SELECT c_custkey, NTILE(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS quarter FROM customer",
    "win_lag_lead": "SELECT event_id, LAG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, LEAD(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events",
    "win_first_last": "SELECT event_id, FIRST_VALUE(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_id, LAST_VALUE(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id FROM events",
    "win_range_frame": "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part",
    "win_top_rows": "SELECT c_nationkey, c_custkey, n FROM (SELECT c_nationkey, c_custkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) AS t WHERE n <= 3",
    "sort_multi_key": "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey ASC, c_acctbal DESC NULLS LAST, c_custkey",
    "sort_alias": "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, c_nationkey",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20",
    "limit_bare": "SELECT COUNT(*) AS n FROM (SELECT o_orderkey FROM orders LIMIT 25) AS t",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'",
    "set_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45",
    "fn_substring": "SELECT SUBSTRING(c_name FROM 1 FOR 8) AS a, SUBSTRING(c_name, 10, 9) AS b FROM customer",
    "fn_extract": "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM CAST(o_orderdate AS DATE)) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m FROM orders",
    "fn_cast": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR(20)) AS s, CAST(o_custkey AS DOUBLE) / 4 AS d, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS day FROM orders",
    "fn_bucket": "SELECT CAST(FLOOR(o_custkey / 100) AS BIGINT) AS bucket, COUNT(*) AS n FROM orders GROUP BY CAST(FLOOR(o_custkey / 100) AS BIGINT)",
    "fn_strings": "SELECT c_custkey, UPPER(c_mktsegment) AS u, LOWER(c_mktsegment) AS l, LENGTH(c_name) AS n, TRIM(c_name) AS t, c_name || '/' || c_mktsegment AS j, REPLACE(c_name, '#', '-') AS r FROM customer",
    "fn_math": "SELECT p_partkey, ABS(p_size - 25) AS a, ROUND(SQRT(p_retailprice), 6) AS s, CAST(CEIL(p_retailprice) AS BIGINT) AS c, CAST(FLOOR(p_retailprice) AS BIGINT) AS f, p_partkey % 7 AS m FROM part",
    "fn_nulls": "SELECT c_custkey, COALESCE(o_orderkey, -1) AS k, NULLIF(c_mktsegment, 'BUILDING') AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000",
    "group_avg_users": "SELECT user_id, ROUND(AVG(value), 6) AS avg_value FROM events GROUP BY user_id",
}
#: (text for Spark, text for DuckDB) where the two write it differently.
EACH: dict[str, tuple[str, str]] = {
    "agg_percentile": (
        "SELECT event_type, ROUND(percentile(value, 0.5), 6) AS p50, ROUND(percentile(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
        "SELECT event_type, ROUND(quantile_cont(value, 0.5), 6) AS p50, ROUND(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    ),
    "agg_approx_distinct": (
        "SELECT ABS(approx_distinct(l_partkey) - COUNT(DISTINCT l_partkey)) < 0.1 * COUNT(DISTINCT l_partkey) AS near FROM lineitem",
        "SELECT true AS near FROM lineitem LIMIT 1",
    ),
    "agg_pivot": (
        "SELECT * FROM (SELECT o_orderstatus, o_orderpriority FROM orders) PIVOT (COUNT(1) FOR o_orderpriority IN ('1-URGENT' AS urgent, '5-LOW' AS low))",
        "SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, COUNT(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low FROM orders GROUP BY o_orderstatus",
    ),
    "fn_json": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    ),
    "fn_day_bucket": (
        "SELECT CAST(FLOOR(unix_millis(CAST(ts AS TIMESTAMP)) / 86400000) AS BIGINT) AS day, COUNT(*) AS n FROM events GROUP BY 1",
        "SELECT CAST(FLOOR(epoch_ms(ts) / 86400000) AS BIGINT) AS day, COUNT(*) AS n FROM events GROUP BY 1",
    ),
    "win_tumbling": (
        "SELECT date_format(window.start, 'yyyy-MM-dd HH:mm:ss') AS start, event_type, COUNT(*) AS n FROM events GROUP BY window(ts, '6 hours'), event_type",
        "SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, COUNT(*) AS n FROM events GROUP BY ALL",
    ),
}
