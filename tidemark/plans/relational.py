"""The relational battery: SQL over the star schema.  ``{table}`` stands for a table in both dialects."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import sqlapi
from ..sources.tables import folder, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def both(name: str, text: str, duck: str | None = None, args: list | None = None) -> None:
    """Register ``text``; ``duck`` is DuckDB's form where it differs."""
    names = dict.fromkeys(re.findall(r"\{(\w+)\}", text))

    def run(spark: SparkSession, d: str) -> DataFrame:
        return sqlapi.run(spark, text, args or (), {t: table(spark, d, t) for t in names})

    QUERIES[name] = run
    SQL[name] = re.sub(r"\{(\w+)\}", r"\1", duck or text)


# joins

both("sql_join_inner", "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM {customer} JOIN {orders} ON c_custkey = o_custkey WHERE o_totalprice > 200000")
both("sql_join_left", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey")
both("sql_join_right", "SELECT n_name, count(s_suppkey) AS n_suppliers FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_name")
both("sql_join_full", "SELECT n.n_nationkey, s.s_suppkey FROM (SELECT * FROM {nation} WHERE n_nationkey < 15) n FULL JOIN (SELECT * FROM {supplier} WHERE s_nationkey > 5) s ON n.n_nationkey = s.s_nationkey")
both("sql_join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation} WHERE n_nationkey < 5")
both("sql_join_theta", "SELECT a.n_name AS low, b.n_name AS high FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("sql_join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
both("sql_join_using_natural", "SELECT nk, n_name, s_name FROM (SELECT n_nationkey AS nk, n_name FROM {nation}) JOIN (SELECT s_nationkey AS nk, s_name FROM {supplier}) USING (nk)")
both("sql_join_natural", "SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM {nation}) a NATURAL JOIN (SELECT s_nationkey AS k, s_name FROM {supplier}) b")
both(
    "sql_semi_anti",
    """SELECT 'with' AS kind, count(*) AS n FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)
UNION ALL SELECT 'without', count(*) FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)
UNION ALL SELECT 'in', count(*) FROM {customer} WHERE c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 2)
UNION ALL SELECT 'not in', count(*) FROM {customer} WHERE c_nationkey NOT IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 2)""",
)
both("sql_correlated_subquery", "SELECT o_orderkey, o_totalprice FROM {orders} o WHERE o_totalprice > 1.5 * (SELECT avg(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
both("sql_scalar_subquery", "SELECT p_partkey, round(p_retailprice - (SELECT avg(p_retailprice) FROM {part}), 4) AS above FROM {part} WHERE p_size > 45")
both("sql_cte", "WITH t AS (SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey) SELECT c_mktsegment, count(*) AS n, round(max(total), 2) AS best FROM t JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment")
both("sql_recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
both("sql_lateral", "SELECT n_name, top.s_suppkey FROM {nation} n, LATERAL (SELECT s_suppkey FROM {supplier} s WHERE s.s_nationkey = n.n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 1) top")

# aggregation

both("sql_groupby_having", "SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM {lineitem} GROUP BY l_suppkey HAVING count(*) > 590")
both("sql_agg_distinct_filter", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 6) AS open_qty FROM {lineitem} GROUP BY l_returnflag")
both("sql_group_concat", "SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey")
both("sql_total", "SELECT r_name, coalesce(sum(s_acctbal), CAST(0 AS DOUBLE)) >= 0 AS ok, count(s_suppkey) AS n, round(coalesce(sum(CASE WHEN s_acctbal > 1e9 THEN s_acctbal END), CAST(0 AS DOUBLE)), 2) AS nothing FROM {region} LEFT JOIN {nation} ON n_regionkey = r_regionkey LEFT JOIN {supplier} ON s_nationkey = n_nationkey GROUP BY r_name")
both("sql_min_max_any", "SELECT p_brand, min(p_retailprice) AS low, max(p_retailprice) AS high, max_by(p_partkey, p_retailprice * 100000 + p_partkey) AS dearest FROM {part} GROUP BY p_brand", "SELECT p_brand, min(p_retailprice) AS low, max(p_retailprice) AS high, max_by(p_partkey, p_retailprice * 100000 + p_partkey) AS dearest FROM {part} GROUP BY p_brand")
both("sql_json_group", "SELECT n_regionkey, to_json(array_sort(collect_list(n_name))) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, to_json(list(n_name ORDER BY n_name))::VARCHAR AS names FROM {nation} GROUP BY n_regionkey")
both("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus) AS g FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus)::TINYINT AS g FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
both("sql_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM {customer}")

# windows

_W = "SELECT o_orderkey, {} FROM {{orders}}"
both("sql_window_rank", _W.format("row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr") + " WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", _W.format("row_number() OVER w::INT AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)::INT AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)::INT AS dr").replace("OVER w::INT", "OVER w") + " WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
both("sql_window_lag_lead", _W.format("lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, lead(o_totalprice, 2, CAST(0 AS DOUBLE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after"))
both("sql_window_frames", _W.format("round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS near, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS recent"))
both("sql_window_ntile", _W.format("ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS quarter"), _W.format("ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)::INT AS quarter"))
both("sql_window_nth_value", _W.format("nth_value(o_orderkey, 2) OVER w AS second, first_value(o_orderkey) OVER w AS first, last_value(o_orderkey) OVER w AS last") + " WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
both("sql_window_percent", _W.format("round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice), 9) AS pr, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_totalprice), 9) AS cd"))
both(
    "sql_window_groups",
    # a frame of groups is one of ranges over the dense rank
    "SELECT o_orderkey, sum(1) OVER (PARTITION BY o_custkey ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (SELECT o_orderkey, o_custkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS g FROM {orders})",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM {orders}",
)

# set operations, order and limits

both("sql_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
both("sql_union_all", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}) u GROUP BY k")
both("sql_intersect", "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000")
both("sql_except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 8000")
both("sql_order_nulls_limit_offset", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 300000 ORDER BY o_orderkey NULLS FIRST, c_custkey LIMIT 40 OFFSET 20")

# functions

both("sql_string_functions", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_type) AS n, substr(p_name, 2, 4) AS s, trim(concat('  ', p_brand, ' ')) AS t, replace(p_type, ' ', '_') AS r, instr(p_name, 'e') AS i FROM {part}", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_type)::INT AS n, substr(p_name, 2, 4) AS s, trim(concat('  ', p_brand, ' ')) AS t, replace(p_type, ' ', '_') AS r, instr(p_name, 'e')::INT AS i FROM {part}")
both("sql_math_functions", "SELECT p_partkey, abs(p_size - 25) AS a, round(sqrt(p_retailprice), 6) AS s, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, p_size % 7 AS m, round(ln(p_retailprice), 6) AS l, sign(p_size - 25.0) AS g, round(power(p_size, 2), 2) AS p FROM {part}", "SELECT p_partkey, abs(p_size - 25) AS a, round(sqrt(p_retailprice), 6) AS s, floor(p_retailprice)::BIGINT AS f, ceil(p_retailprice)::BIGINT AS c, p_size % 7 AS m, round(ln(p_retailprice), 6) AS l, sign(p_size - 25.0)::DOUBLE AS g, round(power(p_size, 2), 2) AS p FROM {part}")
both("sql_date_functions", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_format(o_orderdate, 'yyyy-MM-dd') AS d, unix_timestamp(o_orderdate) AS u, CAST(date_add(o_orderdate, 30) AS STRING) AS later FROM {orders} WHERE o_orderkey < 3000", "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, strftime(o_orderdate, '%Y-%m-%d') AS d, epoch(o_orderdate)::BIGINT AS u, (o_orderdate::DATE + 30)::VARCHAR AS later FROM {orders} WHERE o_orderkey < 3000")
both("sql_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS done, nullif(o_orderstatus, 'O') AS st FROM {orders}")
both("sql_cast", "SELECT p_partkey, CAST(p_size AS STRING) AS s, CAST(p_retailprice AS INT) AS i, CAST(CAST(p_size AS STRING) AS BIGINT) + 1 AS b FROM {part}", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, trunc(p_retailprice)::INT AS i, CAST(CAST(p_size AS VARCHAR) AS BIGINT) + 1 AS b FROM {part}")
both("sql_like", "SELECT p_partkey FROM {part} WHERE p_name ILIKE '%E%' AND p_type LIKE '%A%' AND p_brand NOT LIKE '%3'")
both("sql_between_in", "SELECT p_partkey FROM {part} WHERE p_size BETWEEN 10 AND 20 AND p_partkey % 10 IN (1, 3, 5)")
both("sql_json_functions", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, to_json(named_struct('id', event_id, 'type', event_type)) AS j, json_array_length('[1,2,3]') AS n FROM {events}", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, to_json({'id': event_id, 'type': event_type})::VARCHAR AS j, json_array_length('[1,2,3]')::INT AS n FROM events")
both("sql_int_div", "SELECT p_partkey, p_size div 7 AS q, -p_size div 7 AS nq, try_divide(p_size, p_size - p_size) AS z FROM {part}", "SELECT p_partkey, (p_size // 7)::BIGINT AS q, ((-p_size) // 7)::BIGINT AS nq, NULL::DOUBLE AS z FROM {part}")
both("sql_params_filter", "SELECT p_partkey, p_name FROM {part} WHERE p_size > ? AND p_brand = ? AND ? = 1", "SELECT p_partkey, p_name FROM {part} WHERE p_size > 30 AND p_brand = 'Brand#13'", args=[30, "Brand#13", True])
both("sql_coalesce_null", "SELECT c_custkey, coalesce(o_orderkey, -1) AS o, o_orderkey IS NULL AS missing FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'P'")
both("sql_values", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) t(id, name)")

# the embedded dialect, rewritten


def dialect(name: str, text: str, duck: str) -> None:
    both(name, sqlapi.rewritten(text), duck)


dialect(
    "sql_dialect_division",
    "SELECT p_partkey, p_size / 7 AS q, -p_size / 7 AS nq, p_size / (p_size - p_size) AS z, p_size % 0 AS r, p_size * 3 / 7 AS m, p_retailprice / 4 AS f FROM {part}",
    "SELECT p_partkey, trunc(p_size / 7)::DOUBLE AS q, trunc(-p_size / 7)::DOUBLE AS nq, NULL::DOUBLE AS z, NULL::INT AS r, trunc(p_size * 3 / 7)::DOUBLE AS m, p_retailprice / 4 AS f FROM {part}",
)
dialect(
    "sql_dialect_functions",
    "SELECT p_partkey, iif(p_size > 25, 'big', 'small') AS size, max(p_size, 10) AS most, min(p_size, 10, 20) AS least, p_name LIKE '%A%' AS has, p_size IS 7 AS seven, ifnull(nullif(p_size, 7), -1) AS s, instr(p_name, 'a') AS at FROM {part}",
    "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size, greatest(p_size, 10) AS most, least(p_size, 10, 20) AS least, p_name ILIKE '%A%' AS has, p_size = 7 AS seven, coalesce(nullif(p_size, 7), -1) AS s, instr(p_name, 'a')::INT AS at FROM {part}",
)
dialect(
    "sql_dialect_aggregates",
    "SELECT r_name, total(s_acctbal) >= 0 AS ok, total(s_acctbal) / count(*) > 0 AS mean, json_group_array(n_regionkey) AS keys, count(*) AS n FROM {region} JOIN {nation} ON r_regionkey = n_regionkey LEFT JOIN {supplier} ON s_nationkey = n_nationkey GROUP BY r_name",
    "SELECT r_name, coalesce(sum(s_acctbal), 0) >= 0 AS ok, coalesce(sum(s_acctbal), 0) / count(*) > 0 AS mean, '[' || string_agg(n_regionkey::VARCHAR, ',') || ']' AS keys, count(*) AS n FROM {region} JOIN {nation} ON r_regionkey = n_regionkey LEFT JOIN {supplier} ON s_nationkey = n_nationkey GROUP BY r_name",
)


def sql_statements(spark: SparkSession, d: str) -> DataFrame:
    """A table's life in statements: filled from orders, updated, deleted from, inserted into; what is in it then."""
    tables = sqlapi.Tables(spark, folder(spark, "sql"))
    tables.execute("CREATE TABLE o (id INTEGER PRIMARY KEY, status TEXT, price REAL)")
    tables.insert("o", table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS status", "o_totalprice AS price"))
    tables.execute("UPDATE o SET price = price * ?, status = 'X' WHERE status = ? AND id % 2 = 0", [2, "F"])
    tables.execute("DELETE FROM o WHERE status = ? OR price < 1000", ["P"])
    tables.execute("INSERT INTO o (id, status) SELECT id + 100000000, 'N' FROM o WHERE status = 'X'")
    return tables.execute("SELECT status, count(*) AS n, sum(id) AS ids, round(total(price), 1) AS price FROM o GROUP BY status")["rows"]


QUERIES["sql_statements"] = sql_statements
SQL["sql_statements"] = """WITH u AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders),
l AS (SELECT * FROM u WHERE status <> 'P' AND price >= 1000), i AS (SELECT * FROM l UNION ALL SELECT id + 100000000, 'N', NULL FROM l WHERE status = 'X')
SELECT status, count(*) AS n, sum(id)::BIGINT AS ids, round(coalesce(sum(price), 0), 1) AS price FROM i GROUP BY status"""

# TPC-H shaped

both(
    "sql_tpch_q1",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
both(
    "sql_tpch_q3",
    """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY round(sum(l_extendedprice * (1 - l_discount)), 2) DESC, l_orderkey LIMIT 10""",
)
both(
    "sql_tpch_q5",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""",
)
both("sql_tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")


def sql_vector_functions(spark: SparkSession, d: str) -> DataFrame:
    """The vector functions by their SQL names."""
    V.register(spark)
    table(spark, d, "embeddings").createOrReplaceTempView("tidemark_embeddings")
    return spark.sql(
        """SELECT a.vec_id AS id, round(cosine_similarity(a.embedding, b.embedding), 6) AS cos, round(dot_product(a.embedding, b.embedding), 6) AS dot, round(vector_norm(l2_normalize(a.embedding)), 6) AS unit
        FROM tidemark_embeddings a JOIN tidemark_embeddings b ON b.vec_id = 0"""
    )


QUERIES["sql_vector_functions"] = sql_vector_functions
SQL["sql_vector_functions"] = """SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot, 1.0::DOUBLE AS unit
FROM embeddings a JOIN embeddings b ON b.vec_id = 0"""


def sql_adapter_search(spark: SparkSession, d: str) -> DataFrame:
    """Rows by equality of columns."""
    return sqlapi.equal_rows(table(spark, d, "part"), {"p_brand": "Brand#12", "p_size": 7}).select("p_partkey", F.col("p_name"))


QUERIES["sql_adapter_search"] = sql_adapter_search
SQL["sql_adapter_search"] = "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#12' AND p_size = 7"
