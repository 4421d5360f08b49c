"""The engine's queries by SURVEY category, each with SQL for DuckDB. Where one text serves both engines it is given once."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import relational as R
from ..session import shared_folder
from ..sources.files import tables
from ..streaming import events as streams
from .engine import Database

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text)


def sql(name: str, text: str, oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text)
    ORACLES[name] = oracle or text


def frame(oracle: str, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        ORACLES[name or f.__name__] = oracle
        return f

    return add


# TPC-H, with dates and parameters that the data have, and partsupp taken from lineitem where a query needs it

_PARTSUPP = "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(sum(l_quantity) AS BIGINT) AS ps_availqty, min(l_tax) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey)"


def _over_partsupp(name: str, text: str, wanted: str) -> None:
    """A query whose text takes partsupp as {ps}; Spark aggregates only the lineitem rows that the query can use."""
    sql(name, text.replace("{ps}", _PARTSUPP.replace(" GROUP BY", f" WHERE {wanted} GROUP BY")), text.replace("{ps}", _PARTSUPP))


sql("tpch_q01", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice), 4) AS sum_base_price,
 round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
 round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-08-01' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")
_over_partsupp("tpch_q02", """WITH ps AS {ps}
 SELECT s_acctbal, s_name, n_name, p_partkey, p_name FROM part, supplier, ps, nation, region
 WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = 15 AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
 AND ps_supplycost = (SELECT min(i.ps_supplycost) FROM ps i, supplier j, nation k, region l WHERE p_partkey = i.ps_partkey AND j.s_suppkey = i.ps_suppkey
   AND j.s_nationkey = k.n_nationkey AND k.n_regionkey = l.r_regionkey AND l.r_name = 'EUROPE')
 ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""", "l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 15)")
sql("tpch_q03", """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate FROM customer, orders, lineitem
 WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
 GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
sql("tpch_q04", """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1997-10-01'
 AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority ORDER BY o_orderpriority""")
sql("tpch_q05", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer, orders, lineitem, supplier, nation, region
 WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
 AND r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name ORDER BY revenue DESC, n_name""")


@frame("SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def tpch_q06(spark, sf_dir):
    (li,) = tables(spark, sf_dir, "lineitem")
    kept = li.where((F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return kept.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("revenue"))


sql("tpch_q07", """SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue FROM (
 SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS INT) AS l_year, l_extendedprice * (1 - l_discount) AS volume
 FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey
 AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND ((n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6'))
 AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31') AS shipping GROUP BY supp_nation, cust_nation, l_year ORDER BY 1, 2, 3""")
sql("tpch_q08", """SELECT o_year, round(sum(CASE WHEN nation = 'NATION_2' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
 SELECT CAST(extract(year FROM o_orderdate) AS INT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
 FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey
 AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type = 'ECONOMY'
 AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31') AS all_nations GROUP BY o_year ORDER BY o_year""")
_over_partsupp("tpch_q09", """WITH ps AS {ps}
 SELECT nation, o_year, round(sum(amount), 4) AS sum_profit FROM (SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS INT) AS o_year,
 l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity AS amount FROM part, supplier, lineitem, ps, orders, nation
 WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%ring%') AS profit
 GROUP BY nation, o_year ORDER BY nation, o_year DESC""", "l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '%ring%')")
sql("tpch_q10", """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
 WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= TIMESTAMP '1997-10-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
 GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
_over_partsupp("tpch_q11", """WITH ps AS {ps}, own AS (SELECT ps_partkey, ps_supplycost * ps_availqty AS v FROM ps, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7')
 SELECT ps_partkey, round(sum(v), 4) AS value FROM own GROUP BY ps_partkey HAVING sum(v) > (SELECT sum(v) * 0.0005 FROM own) ORDER BY value DESC, ps_partkey""", "l_suppkey IN (SELECT s_suppkey FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_name = 'NATION_7')")
sql("tpch_q12", """SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
 CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count FROM orders, lineitem
 WHERE o_orderkey = l_orderkey AND l_returnflag IN ('R', 'A') AND l_shipdate > o_orderdate AND l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' GROUP BY l_returnflag ORDER BY l_returnflag""")
sql("tpch_q13", """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT'
 GROUP BY c_custkey) AS c_orders GROUP BY c_count ORDER BY custdist DESC, c_count DESC""")
sql("tpch_q14", """SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
 FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1997-10-01'""")
sql("tpch_q15", """WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total_revenue FROM lineitem
 WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY l_suppkey)
 SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""")
_over_partsupp("tpch_q16", """WITH ps AS {ps}
 SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM ps, part WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
 AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""", "l_partkey IN (SELECT p_partkey FROM part WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9))")
sql("tpch_q17", """SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND p_type = 'SMALL'
 AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)""")
sql("tpch_q18", """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 4) AS sum_quantity FROM customer, orders, lineitem
 WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
 GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""")
sql("tpch_q19", """SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem, part WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity >= 1 AND l_quantity <= 11 AND p_size BETWEEN 1 AND 5)
 OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity >= 10 AND l_quantity <= 20 AND p_size BETWEEN 1 AND 10) OR (p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity >= 20 AND l_quantity <= 30 AND p_size BETWEEN 1 AND 15)""")
_over_partsupp("tpch_q20", """WITH ps AS {ps}
 SELECT s_name, s_suppkey FROM supplier, nation WHERE s_suppkey IN (SELECT ps_suppkey FROM ps WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 's%')
 AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'))
 AND s_nationkey = n_nationkey AND n_name <> 'NATION_3' ORDER BY s_name""", "l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 's%')")
sql("tpch_q21", """SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate
 AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
 AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > TIMESTAMP '2001-01-01')
 AND s_nationkey = n_nationkey AND n_name = 'NATION_5' GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""")
sql("tpch_q22", """SELECT c_mktsegment, count(*) AS numcust, round(sum(c_acctbal), 4) AS totacctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)
 AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-06-01') GROUP BY c_mktsegment ORDER BY c_mktsegment""")

# star-schema flights over lineitem and its dimensions

for _i, (_where, _group) in enumerate(
    (
        ("extract(year FROM o_orderdate) = 1996 AND l_discount BETWEEN 0.01 AND 0.03 AND l_quantity < 25", "1"),
        ("p_type = 'STANDARD' AND r_name = 'AMERICA'", "extract(year FROM o_orderdate), p_brand"),
        ("r_name = 'ASIA' AND extract(year FROM o_orderdate) BETWEEN 1996 AND 1999", "n_name, extract(year FROM o_orderdate)"),
        ("r_name = 'EUROPE' AND p_size BETWEEN 10 AND 20", "extract(year FROM o_orderdate), n_name, p_type"),
    ),
    1,
):
    _keys = [k.strip() for k in re.split(r",\s*(?![^(]*\))", _group)]
    _selected = ", ".join(f"CAST({k} AS STRING) AS k{j}" for j, k in enumerate(_keys))
    sql(
        f"ssb_flight_{_i}",
        f"SELECT {_selected}, round(sum(l_extendedprice * l_discount), 4) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE {_where}" + ("" if _group == "1" else f" GROUP BY {_group}"),
        f"SELECT {_selected.replace('STRING', 'VARCHAR')}, round(sum(l_extendedprice * l_discount), 4) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE {_where}" + ("" if _group == "1" else f" GROUP BY {_group}"),
    )

# the thirteen star-schema queries, over lineitem and its dimensions, with values that the data have: where, and keys

_YEAR, _MONTH = "extract(year FROM o_orderdate)", "extract(month FROM o_orderdate)"
_STAR = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey"
for _name, (_where, *_keys) in {
    "1_1": (f"{_YEAR} = 1996 AND l_discount BETWEEN 0.01 AND 0.03 AND l_quantity < 25",),
    "1_2": (f"{_YEAR} = 1997 AND {_MONTH} = 1 AND l_discount BETWEEN 0.04 AND 0.06 AND l_quantity BETWEEN 26 AND 35",),
    "1_3": (f"{_YEAR} = 1997 AND {_MONTH} BETWEEN 2 AND 3 AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity BETWEEN 26 AND 35",),
    "2_1": ("p_type = 'STANDARD' AND sr.r_name = 'AMERICA'", _YEAR, "p_brand"),
    "2_2": ("p_brand BETWEEN 'Brand#10' AND 'Brand#15' AND sr.r_name = 'ASIA'", _YEAR, "p_brand"),
    "2_3": ("p_brand = 'Brand#12' AND sr.r_name = 'EUROPE'", _YEAR, "p_brand"),
    "3_1": (f"cr.r_name = 'ASIA' AND sr.r_name = 'ASIA' AND {_YEAR} BETWEEN 1996 AND 1999", "cn.n_name", "sn.n_name", _YEAR),
    "3_2": (f"cn.n_name = 'NATION_7' AND sn.n_name = 'NATION_7' AND {_YEAR} BETWEEN 1995 AND 2000", "c_mktsegment", "s_name", _YEAR),
    "3_3": (f"cn.n_name IN ('NATION_6', 'NATION_7') AND sn.n_name IN ('NATION_6', 'NATION_7') AND {_YEAR} BETWEEN 1995 AND 2000", "cn.n_name", "sn.n_name", _YEAR),
    "3_4": (f"cr.r_name = 'EUROPE' AND sr.r_name = 'EUROPE' AND {_YEAR} = 1997 AND {_MONTH} = 12", "cn.n_name", "sn.n_name"),
    "4_1": ("cr.r_name = 'AMERICA' AND sr.r_name = 'AMERICA' AND p_type IN ('STANDARD', 'ECONOMY')", _YEAR, "cn.n_name"),
    "4_2": (f"cr.r_name = 'AMERICA' AND sr.r_name = 'AMERICA' AND {_YEAR} IN (1997, 1998) AND p_type IN ('STANDARD', 'ECONOMY')", _YEAR, "sn.n_name", "p_type"),
    "4_3": (f"cr.r_name = 'AMERICA' AND sn.n_name = 'NATION_1' AND {_YEAR} IN (1997, 1998) AND p_type = 'STANDARD'", _YEAR, "s_name", "p_brand"),
}.items():
    _measure = "l_extendedprice * l_discount" if _name[0] == "1" else "l_extendedprice" if _name[0] != "4" else "l_extendedprice * (1 - l_discount) - l_tax * l_quantity"
    _listed = "".join(f"CAST({k} AS VARCHAR(32)) AS k{j}, " for j, k in enumerate(_keys))
    sql(f"ssb_{_name}", f"SELECT {_listed}round(sum({_measure}), 2) AS revenue, count(*) AS n {_STAR} WHERE {_where}" + (f" GROUP BY {', '.join(_keys)}" if _keys else ""))

# a join of many tables, as the join-order benchmark has them

sql("many_joins", """SELECT min(c_name) AS first_customer, min(s_name) AS first_supplier, min(p_name) AS first_part, count(*) AS n FROM customer, orders, lineitem, part, supplier, nation cn, nation sn, region cr, region sr
 WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND p_partkey = l_partkey AND s_suppkey = l_suppkey AND cn.n_nationkey = c_nationkey AND sn.n_nationkey = s_nationkey AND cr.r_regionkey = cn.n_regionkey AND sr.r_regionkey = sn.n_regionkey
 AND cr.r_name = 'ASIA' AND sr.r_name = 'EUROPE' AND p_size > 40 AND o_orderpriority = '1-URGENT'""")

# scans and predicates

for _name, _where in {
    "scan_column_value": "l_quantity > 45",
    "scan_column_column": "l_tax < l_discount",
    "scan_between": "l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-02-01'",
    "scan_in_list": "l_linenumber IN (1, 3, 5)",
    "scan_not_in_list": "l_linenumber NOT IN (1, 2, 3, 4)",
    "scan_or_split": "l_quantity < 2 OR l_discount > 0.095",
    "scan_not_demorgan": "NOT (l_quantity >= 3 OR l_returnflag = 'N')",
    "scan_expression": "l_quantity * 2 + 1 > 99 AND l_linenumber % 2 = 0",
    "scan_index_point": "l_orderkey = 77",
    "scan_null_logic": "nullif(l_returnflag, 'N') IS NULL",
    "scan_not_null": "nullif(l_linestatus, 'O') IS NOT NULL",
    "scan_constant": "4 > 3",
    "scan_case": "CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 2 END = 2",
}.items():
    sql(_name, f"SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE {_where}")
sql("like_patterns", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 's%g' OR p_name LIKE '_r%' OR p_name NOT LIKE '%a%'")
sql("ilike_patterns", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE 'pro%' OR p_type NOT ILIKE '%A%'")


@frame(r"SELECT p_partkey, CAST((p_brand || '_x') LIKE '%\_x' AS INT) AS hit FROM part")
def like_backslash(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    return part.select("p_partkey", S.as_int(S.like(F.concat("p_brand", F.lit("_x")), "%\\_x")).alias("hit"))


@frame("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')")
def in_list_of_mixed_types(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return events.where(S.in_list(F.col("event_type"), ["click", 5, "error"], "string")).select("event_id", "event_type")


# projections and scalar functions

sql("arithmetic", "SELECT l_orderkey, l_linenumber, -l_quantity AS neg, abs(l_discount - 0.05) AS dist, round(l_extendedprice * (1 + l_tax) - l_discount, 4) AS x, l_linenumber % 3 AS m FROM lineitem")


@frame("SELECT l_orderkey, l_linenumber, CAST(l_partkey // nullif(l_linenumber - 1, 0) AS BIGINT) AS d, CAST(l_partkey % nullif(l_linenumber - 1, 0) AS BIGINT) AS m, round(l_extendedprice / nullif(l_linenumber - 1, 0), 4) AS f FROM lineitem")
def division_by_zero_is_null(spark, sf_dir):
    (li,) = tables(spark, sf_dir, "lineitem")
    b = F.col("l_linenumber") - 1
    return li.select("l_orderkey", "l_linenumber", S.int_div(F.col("l_partkey"), b, "long").alias("d"), S.safe_mod(F.col("l_partkey"), b).cast("long").alias("m"), F.round(S.safe_div(F.col("l_extendedprice"), b), 4).alias("f"))


@frame("SELECT p_partkey, substr(p_name, 0, 3) AS a, substr(p_name, 2, 4) AS b, substr(p_name, -3, 4) AS c, p_brand || '/' || p_type AS d, p_brand || nullif(p_type, 'PROMO') AS e FROM part")
def string_functions(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    n = F.col("p_name")
    return part.select("p_partkey", S.substr(n, 0, 3).alias("a"), S.substr(n, 2, 4).alias("b"), S.substr(n, -3, 4).alias("c"), S.concat("p_brand", F.lit("/"), "p_type").alias("d"), S.concat(F.col("p_brand"), F.nullif("p_type", F.lit("PROMO"))).alias("e"))


@frame("SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS INT) AS i, CAST(l_quantity AS BIGINT) AS l, CAST(l_partkey AS DOUBLE) AS d, CAST(l_linenumber AS VARCHAR) AS s FROM lineitem")
def casts(spark, sf_dir):
    (li,) = tables(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", S.cast_to_int(F.col("l_extendedprice")).alias("i"), S.cast_to_int(F.col("l_quantity"), "long").alias("l"), F.col("l_partkey").cast("double").alias("d"), F.col("l_linenumber").cast("string").alias("s"))


@frame("SELECT event_id, CAST(extract(year FROM ts) AS INT) AS y, CAST(extract(month FROM ts) AS INT) AS mo, CAST(extract(day FROM ts) AS INT) AS d, CAST(extract(hour FROM ts) AS INT) AS h, CAST(extract(minute FROM ts) AS INT) AS mi, round(extract(microseconds FROM ts) / 1000000.0, 3) AS s FROM events")
def extract_parts(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    parts = {"y": "year", "mo": "month", "d": "day", "h": "hour", "mi": "minute"}
    return events.select("event_id", *(S.extract(p, F.col("ts")).alias(a) for a, p in parts.items()), F.round(S.extract("second", F.col("ts")), 3).alias("s"))


sql("case_expressions", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS simple, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS searched, coalesce(nullif(o_orderstatus, 'P'), 'none') AS c FROM orders")
sql("date_intervals", "SELECT o_orderkey FROM orders WHERE o_orderdate >= CAST('1996-01-31' AS DATE) + INTERVAL '1' MONTH AND o_orderdate < DATE '1996-03-15' + INTERVAL '10' DAY AND o_orderdate < DATE '1995-06-01' + INTERVAL '1' YEAR")
sql("select_without_from", "SELECT 1 AS a, 2 + 3 AS b, 'x' AS c")
sql("aliases", "SELECT x.k AS key_alias, x.v + 1 AS value_plus FROM (SELECT n_nationkey AS k, n_regionkey AS v FROM nation) AS x WHERE x.v > 1")
sql("column_aliases_of_derived_table", "SELECT y, z FROM (SELECT n_nationkey, n_name FROM nation) AS t (y, z) WHERE y < 7")

# joins

_NOT_P, _R = "(SELECT * FROM orders WHERE o_orderstatus <> 'P')", "(SELECT * FROM lineitem WHERE l_returnflag = 'R')"
for _how in ("JOIN", "LEFT JOIN", "RIGHT JOIN", "FULL OUTER JOIN"):
    sql("join_" + _how.split()[0].lower().replace("join", "inner"), f"SELECT o_orderkey, o_totalprice, l_orderkey, l_partkey, l_quantity FROM {_NOT_P} o {_how} {_R} l ON o.o_orderkey = l.l_orderkey")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_comma", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey <> n_regionkey")
sql("join_semi_exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
sql("join_semi_in", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
sql("join_anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate > TIMESTAMP '2000-01-01')")
sql("join_anti_not_in_null", "SELECT s_nationkey, 'in' AS kind FROM supplier WHERE s_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation WHERE n_nationkey < 5) UNION ALL SELECT s_nationkey, 'exists' AS kind FROM supplier WHERE NOT EXISTS (SELECT 1 FROM nation WHERE nullif(n_nationkey, 3) = s_nationkey AND n_nationkey < 5)")
sql("join_anti_not_in", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
sql("join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_regionkey")
sql("join_theta_left", "SELECT a.n_name AS a, b.r_name AS b FROM nation a LEFT JOIN region b ON a.n_nationkey <= b.r_regionkey AND b.r_name <> 'ASIA'")
sql("join_full_theta", "SELECT a.n_name AS a, b.r_name AS b FROM nation a FULL OUTER JOIN region b ON a.n_nationkey < b.r_regionkey")
sql("join_multi_predicate", "SELECT a.l_orderkey, a.l_partkey AS p, b.l_partkey AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey AND a.l_discount > b.l_discount")
sql("join_expression", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON 5 + a.n_nationkey = 6 + b.n_nationkey")
sql("join_local_predicate", "SELECT n_name, s_name FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000")
sql("join_string_keys", "SELECT a.n_name, b.n_regionkey FROM nation a JOIN nation b ON a.n_name = b.n_name")
sql("join_null_keys", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM (SELECT n_nationkey, nullif(n_regionkey, 1) AS k FROM nation) a LEFT JOIN (SELECT n_nationkey, nullif(n_regionkey, 4) AS k FROM nation) b ON a.k = b.k")


@frame("SELECT l.k AS k, l.v AS v, r.w AS w FROM (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 12) l FULL OUTER JOIN (SELECT n_nationkey AS k, n_regionkey AS w FROM nation WHERE n_nationkey > 8) r ON l.k = r.k")
def join_using_full(spark, sf_dir):
    (nation,) = tables(spark, sf_dir, "nation")
    left = nation.where("n_nationkey < 12").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    right = nation.where("n_nationkey > 8").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("w"))
    return R.using(left, right, ["k"], "full")


@frame("SELECT n_nationkey, n_name, n_regionkey, x FROM nation NATURAL JOIN (SELECT n_regionkey, max(n_name) AS x FROM nation GROUP BY n_regionkey)")
def join_natural(spark, sf_dir):
    (nation,) = tables(spark, sf_dir, "nation")
    return R.natural(nation, nation.groupBy("n_regionkey").agg(F.max("n_name").alias("x")))


for _kind in ("hash", "sort_merge", "nested_loop", "index"):

    def _physical(spark, sf_dir, kind=_kind):
        s, n = tables(spark, sf_dir, "supplier", "nation")
        return R.join(s, n, [("s_nationkey", "=", "n_nationkey")], "inner", kind).select("s_suppkey", "n_name")

    frame("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", f"join_{_kind}")(_physical)


@frame("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation WHERE n_nationkey BETWEEN 4 AND 9)")
def join_anti_null_as_true(spark, sf_dir):
    s, n = tables(spark, sf_dir, "supplier", "nation")
    return R.join(s, n.where("n_nationkey BETWEEN 4 AND 9").select(F.nullif("n_nationkey", F.lit(3)).alias("k")), [("s_nationkey", "=", "k")], "anti_null_as_true").select("s_suppkey")


# aggregates

sql("agg_all_functions", "SELECT l_returnflag, count(*) AS n, count(nullif(l_linestatus, 'O')) AS n_some, count(DISTINCT l_suppkey) AS n_supp, round(sum(l_quantity), 4) AS q, CAST(sum(l_linenumber) AS BIGINT) AS ln, round(avg(l_discount), 6) AS d, min(l_shipdate) AS first_ship, max(l_linestatus) AS last_status, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY l_returnflag")
sql("agg_no_keys", "SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_orderpriority) AS hi, count(DISTINCT o_custkey) AS c FROM orders")
sql("agg_empty_input", "SELECT count(*) AS n, count(l_tax) AS m, sum(l_quantity) AS s, max(l_returnflag) AS x FROM lineitem WHERE l_orderkey < 0")
sql("agg_stddev_single", "SELECT n_nationkey, stddev_samp(n_regionkey) AS sd FROM nation GROUP BY n_nationkey")
sql("agg_null_group", "SELECT nullif(o_orderstatus, 'P') AS s, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS c FROM orders GROUP BY nullif(o_orderstatus, 'P')")
sql("agg_expression_keys", "SELECT o_custkey % 10 AS k, count(*) AS n FROM orders GROUP BY o_custkey % 10")
sql("agg_three_keys", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, max(l_extendedprice) AS x FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber")
sql("agg_having", "SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 8) AS a FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 300000")
sql("agg_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
sql("agg_group_without_aggregates", "SELECT c_mktsegment, c_nationkey FROM customer GROUP BY c_mktsegment, c_nationkey")
sql("agg_count_distinct_many", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_orderstatus")


@frame("SELECT c_custkey, any_value(c_name) AS c_name, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def agg_dependent_keys(spark, sf_dir):
    c, o = tables(spark, sf_dir, "customer", "orders")
    counts = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return counts.join(c, c.c_custkey == counts.o_custkey).select("c_custkey", "c_name", "n")


@frame("SELECT o_orderstatus, CAST(sum(o_custkey) AS BIGINT) AS s, count(o_orderkey) AS n, min(o_orderpriority) AS lo FROM orders GROUP BY o_orderstatus")
def agg_operator(spark, sf_dir):
    (o,) = tables(spark, sf_dir, "orders")
    return R.aggregate(o, ["o_orderstatus"], [("sum", "o_custkey", "s"), ("count", "o_orderkey", "n"), ("min", "o_orderpriority", "lo")])


# windows

_W = "PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey NULLS FIRST"
sql("window_ranks", f"SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST) AS BIGINT) AS d, CAST(row_number() OVER ({_W}) AS BIGINT) AS n FROM orders")
sql("window_distribution", f"SELECT o_orderkey, round(percent_rank() OVER ({_W}), 9) AS p, round(cume_dist() OVER ({_W}), 9) AS c FROM orders")
sql("window_running", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_W}), 4) AS s, count(*) OVER ({_W}) AS n, round(avg(o_totalprice) OVER ({_W}), 8) AS a, min(o_totalprice) OVER ({_W}) AS lo, max(o_totalprice) OVER ({_W}) AS hi FROM orders")
sql("window_rows_frame", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS s, max(o_totalprice) OVER ({_W} ROWS 3 PRECEDING) AS m FROM orders")
sql("window_range_frame", "SELECT l_orderkey, l_partkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM lineitem")
sql("window_default_frame_peers", "SELECT l_orderkey, l_partkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 4) AS s FROM lineitem")
sql("window_stddev", "SELECT o_orderkey, round(stddev_samp(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS sd FROM orders")
sql("window_after_having", "SELECT o_custkey, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC) AS BIGINT) AS r FROM orders GROUP BY o_custkey HAVING count(*) > 8")


@frame("SELECT o_orderkey, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS n FROM orders")
def window_count_distinct(spark, sf_dir):
    (o,) = tables(spark, sf_dir, "orders")
    return R.counted(o, "o_orderpriority", ["o_custkey"], "n").select("o_orderkey", "n")


# sorting, limits, set operations

sql("sort_nulls_first", "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders ORDER BY s DESC NULLS FIRST, o_orderkey")
sql("sort_by_expression", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice * -1 NULLS FIRST, o_orderkey")
sql("sort_by_aggregate", "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY sum(o_orderkey) DESC NULLS FIRST, o_custkey")
sql("sort_by_hidden_column", "SELECT c_name FROM customer ORDER BY c_acctbal NULLS FIRST, c_custkey")
sql("limit_expression", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 1 + 4")
sql("limit_zero", "SELECT n_nationkey FROM nation LIMIT 0")


@frame("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, sf_dir):
    (o,) = tables(spark, sf_dir, "orders")
    return R.top(o.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 25, ["o_totalprice"])


_A, _B = "SELECT l_partkey AS k, l_linenumber AS n FROM lineitem WHERE l_returnflag <> 'N'", "SELECT l_partkey AS k, l_linenumber AS n FROM lineitem WHERE l_returnflag <> 'R'"
for _name, _op in (("union", "UNION"), ("union_all", "UNION ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL")):

    def _set(spark, sf_dir, name=_name):
        (li,) = tables(spark, sf_dir, "lineitem")
        a, b = (li.where(w).select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("n")) for w in ("l_returnflag <> 'N'", "l_returnflag <> 'R'"))
        return R.set_operation(a, b, name.split("_")[0], name.endswith("_all"))

    frame(f"{_A} {_op} {_B}", f"set_{_name}")(_set)
sql("set_branch_limits", "(SELECT n_name AS x FROM nation ORDER BY n_name LIMIT 3) UNION ALL (SELECT r_name AS x FROM region ORDER BY r_name DESC LIMIT 2)")

# subqueries, CTEs

sql("subquery_scalar", "SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 4) AS diff FROM orders")
sql("subquery_scalar_empty", "SELECT n_nationkey, (SELECT max(r_name) FROM region WHERE r_regionkey < 0) AS x FROM nation")
sql("subquery_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
sql("subquery_correlated_select", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n FROM customer")
sql("subquery_correlated_range", "SELECT a.n_nationkey, (SELECT count(*) FROM nation b WHERE b.n_regionkey < a.n_regionkey) AS n FROM nation a")
sql("subquery_exists_or", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) OR c_acctbal > 9800")
sql("subquery_outer_reference_in_aggregate", "SELECT n_nationkey, (SELECT max(r_regionkey) FROM region) + n_nationkey AS x FROM nation")
sql("cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 400000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM per JOIN customer ON o_custkey = c_custkey WHERE n > 1")
sql("in_subquery_rewrite", "SELECT count(*) AS n FROM lineitem WHERE l_linenumber IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22)")


@frame("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 4")
def prepared_statement(spark, sf_dir):
    db = Database(spark)
    db.add("nation", tables(spark, sf_dir, "nation")[0])
    return db.session().run("PREPARE p FROM 'SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = ? AND n_nationkey > ?'; EXECUTE p (2, 4)")


@frame("SELECT n_regionkey AS k, count(*) AS n FROM nation WHERE n_nationkey > 10 GROUP BY n_regionkey")
def view(spark, sf_dir):
    db = Database(spark)
    db.add("nation", tables(spark, sf_dir, "nation")[0])
    return db.session().run("CREATE VIEW v (k, n) AS SELECT n_regionkey, count(*) FROM nation WHERE n_nationkey > 10 GROUP BY n_regionkey; SELECT * FROM v")


@frame("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey <> 5 UNION ALL SELECT 99, 'NEW', NULL")
def insert_update_delete(spark, sf_dir):
    db = Database(spark)
    db.add("nation", tables(spark, sf_dir, "nation")[0])
    return db.session().run("BEGIN; INSERT INTO nation (n_nationkey, n_name) VALUES (99, 'NEW'); DELETE FROM nation WHERE n_nationkey = 5; UPDATE nation SET n_name = concat(upper(n_name), '!') WHERE n_regionkey = 1; COMMIT; SELECT * FROM nation")


@frame("SELECT * FROM (VALUES ('nation', 'n_name', 'string'), ('nation', 'n_nationkey', 'int'), ('nation', 'n_regionkey', 'int')) t (table_name, column_name, data_type)")
def meta_columns(spark, sf_dir):
    db = Database(spark)
    db.add("nation", tables(spark, sf_dir, "nation")[0])
    return db.session().run("SELECT table_name, column_name, data_type FROM meta_columns")


@frame("SELECT 'c_custkey' AS column_name, CAST(count(*) = count(DISTINCT c_custkey) AS INT) AS is_unique FROM customer UNION ALL SELECT 'c_mktsegment', CAST(count(*) = count(DISTINCT c_mktsegment) AS INT) FROM customer")
def unique_column_discovery(spark, sf_dir):
    (c,) = tables(spark, sf_dir, "customer")
    return R.unique_columns(c.select("c_custkey", "c_mktsegment"))


# statements through a session


def through(name: str, names: str, text: str, oracle: str):
    """A query that runs statements in the engine's dialect over some tables; {folder} stands for a new shared folder."""

    def run(spark, sf_dir):
        db = Database(spark)
        for n in names.split():
            db.add(n, tables(spark, sf_dir, n)[0])
        return db.session().run(text.replace("{folder}", f"{shared_folder(spark)}/{uuid.uuid4().hex}"))

    frame(oracle, name)(run)


through("sql_division", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey / (l_linenumber - 1) AS q, l_partkey % (l_linenumber - 1) AS m, l_partkey / 3 / 2 AS t, l_quantity / (l_linenumber - 1) AS d FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_partkey // nullif(l_linenumber - 1, 0) AS q, l_partkey % nullif(l_linenumber - 1, 0) AS m, l_partkey // 3 // 2 AS t, l_quantity / nullif(l_linenumber - 1, 0) AS d FROM lineitem")
through("sql_strings", "part", r"SELECT p_partkey, substr(p_name, 0, 3) AS a, substr(p_name, -3, 4) AS b, CAST(p_name LIKE '%\_%' AS INT) AS c, p_name ILIKE 'S%' AS d FROM part",
        r"SELECT p_partkey, substr(p_name, 0, 3) AS a, substr(p_name, -3, 4) AS b, CAST(p_name LIKE '%\_%' AS INT) AS c, CAST(p_name ILIKE 'S%' AS INT) AS d FROM part")
through("sql_truth_values", "orders", "SELECT o_orderkey, o_totalprice > 200000 AS big, nullif(o_orderstatus, 'P') = 'F' AS final FROM orders",
        "SELECT o_orderkey, CAST(o_totalprice > 200000 AS INT) AS big, CAST(nullif(o_orderstatus, 'P') = 'F' AS INT) AS final FROM orders")
through("sql_nulls_first", "orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'P') DESC, o_orderkey) AS n FROM orders",
        "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'P') DESC NULLS FIRST, o_orderkey) AS n FROM orders")
through("sql_in_list_of_mixed_types", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (1, '2', 3) AND l_returnflag IN ('R', 5)",
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (1, 3) AND l_returnflag = 'R'")
through("sql_count_distinct_over", "orders", "SELECT o_orderkey, count(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey) AS n FROM orders",
        "SELECT o_orderkey, count(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey) AS n FROM orders")
through("sql_alias_in_where", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem WHERE twice > 90",
        "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem WHERE l_quantity * 2 > 90")
through("sql_star_under_group_by", "nation", "SELECT * FROM nation GROUP BY n_nationkey, n_name, n_regionkey", "SELECT * FROM nation")
through("sql_table_star_under_group_by", "nation region", "SELECT r.*, count(*) AS n FROM nation JOIN region AS r ON n_regionkey = r_regionkey GROUP BY r.r_regionkey, r.r_name",
        "SELECT r_regionkey, r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
through("sql_distinct_sums", "lineitem", "SELECT l_returnflag, sum(DISTINCT l_linenumber) AS s, avg(DISTINCT l_linenumber) AS a FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, avg(DISTINCT l_linenumber) AS a FROM lineitem GROUP BY l_returnflag")
through("sql_aggregates_across_levels", "orders", "SELECT sum(n) AS s, max(n) AS m, count(*) AS c FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) AS by_customer",
        "SELECT CAST(sum(n) AS BIGINT) AS s, max(n) AS m, count(*) AS c FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)")
through("sql_rollback", "nation", "BEGIN; DELETE FROM nation WHERE n_regionkey = 2; ROLLBACK; SELECT * FROM nation", "SELECT * FROM nation")
through("sql_create_table", "nation", "CREATE TABLE t (a INT, b VARCHAR(20)); INSERT INTO t SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1; INSERT INTO t (b) VALUES ('none'); SELECT * FROM t",
        "SELECT n_nationkey AS a, n_name AS b FROM nation WHERE n_regionkey = 1 UNION ALL SELECT NULL, 'none'")
through("sql_create_table_as", "orders", "CREATE TABLE big AS SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000; SELECT count(*) AS n, min(o_orderkey) AS lo FROM big", "SELECT count(*) AS n, min(o_orderkey) AS lo FROM orders WHERE o_totalprice > 400000")
through("sql_drop_table", "nation region", "DROP TABLE region; SHOW TABLES", "SELECT 'nation' AS table_name, CAST(3 AS INT) AS column_count, count(*) AS row_count, CAST(1 AS INT) AS chunk_count, CAST(NULL AS BIGINT) AS target_chunk_size FROM nation")
through("sql_drop_view", "nation", "CREATE VIEW v AS SELECT 1 AS a; DROP VIEW v; CREATE VIEW v AS SELECT n_name AS a FROM nation; SELECT * FROM v", "SELECT n_name AS a FROM nation")
through("sql_view_follows_table", "nation", "CREATE VIEW v AS SELECT count(*) AS n FROM nation; DELETE FROM nation WHERE n_regionkey = 0; SELECT * FROM v", "SELECT count(*) AS n FROM nation WHERE n_regionkey <> 0")
through("sql_copy_csv", "nation", "CREATE TABLE t AS SELECT n_nationkey, nullif(n_name, 'NATION_3') AS n_name FROM nation; COPY t TO '{folder}/t.csv'; COPY u FROM '{folder}/t.csv'; SELECT * FROM u", "SELECT n_nationkey, nullif(n_name, 'NATION_3') AS n_name FROM nation")
through("sql_copy_bin", "supplier", "COPY supplier TO '{folder}/s.bin'; COPY u FROM '{folder}/s.bin' WITH FORMAT bin; SELECT * FROM u", "SELECT * FROM supplier")
through("sql_import", "nation", "COPY nation TO '{folder}/n.bin'; IMPORT FROM BIN FILE '{folder}/n.bin' INTO nation; SELECT n_nationkey, count(*) AS n FROM nation GROUP BY n_nationkey", "SELECT n_nationkey, CAST(2 AS BIGINT) AS n FROM nation")
through("meta_tables", "nation region", "SELECT table_name, column_count, row_count FROM meta_tables", "SELECT 'nation' AS table_name, 3 AS column_count, count(*) AS row_count FROM nation UNION ALL SELECT 'region', 2, count(*) FROM region")
through("meta_chunks", "orders", "SELECT table_name, sum(row_count) AS n, sum(invalid_row_count) AS gone FROM meta_chunks GROUP BY table_name", "SELECT 'orders' AS table_name, count(*) AS n, CAST(0 AS BIGINT) AS gone FROM orders")
through("meta_segments", "nation", "SELECT table_name, column_id, column_name, column_data_type, distinct_value_count FROM meta_segments",
        "SELECT 'nation' AS table_name, i AS column_id, c AS column_name, t AS column_data_type, n AS distinct_value_count FROM (SELECT 0 AS i, 'n_nationkey' AS c, 'int' AS t, count(DISTINCT n_nationkey) AS n FROM nation UNION ALL SELECT 1, 'n_name', 'string', count(DISTINCT n_name) FROM nation UNION ALL SELECT 2, 'n_regionkey', 'int', count(DISTINCT n_regionkey) FROM nation)")
through("show_columns", "nation", "SHOW COLUMNS nation", "SELECT * FROM (VALUES ('nation', 'n_nationkey', 'int', 1), ('nation', 'n_name', 'string', 1), ('nation', 'n_regionkey', 'int', 1)) t (table_name, column_name, data_type, nullable)")
through("meta_log", "nation", "SELECT count(*) AS a FROM nation; SELECT count(*) AS n FROM meta_log WHERE reporter = 'sql'", "SELECT CAST(2 AS BIGINT) AS n")


@frame("SELECT 'greet' AS plugin_name, 'hello' AS function_name, 1 AS loaded, 2 AS calls")
def meta_plugins(spark, sf_dir):
    db, calls = Database(spark), []
    db.plugins["greet"] = {"hello": lambda: calls.append(1)}
    s = db.session()
    s.run("INSERT INTO meta_plugins VALUES ('greet'); INSERT INTO meta_exec VALUES ('greet', 'hello'); INSERT INTO meta_exec VALUES ('greet', 'hello')")
    return s.run(f"SELECT plugin_name, function_name, CAST((SELECT count(*) FROM meta_plugins) AS INT) AS loaded, {len(calls)} AS calls FROM meta_exec")


@frame("SELECT 'verbosity' AS name, '3' AS value, 'how much is told' AS description")
def meta_settings(spark, sf_dir):
    db = Database(spark)
    db.settings["verbosity"] = ("1", "how much is told")
    return db.session().run("UPDATE meta_settings SET value = '3' WHERE name = 'verbosity'; SELECT * FROM meta_settings WHERE name = 'verbosity'")


@frame("SELECT '| r_regionkey | r_name      |' AS line UNION ALL SELECT '|-------------|-------------|' UNION ALL SELECT '| ' || rpad(CAST(r_regionkey AS VARCHAR), 11, ' ') || ' | ' || rpad(r_name, 11, ' ') || ' |' FROM region")
def print_table(spark, sf_dir):
    (region,) = tables(spark, sf_dir, "region")
    return spark.createDataFrame([(x,) for x in R.render(region.orderBy("r_regionkey")).split("\n")], "line string")


# beyond the reference's SQL

sql("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("approximate_distinct", "SELECT CAST(abs(approx_count_distinct(o_custkey) / count(DISTINCT o_custkey) - 1) < 0.15 AS INT) AS close FROM orders", "SELECT 1 AS close")
sql("offset", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 3")
sql("json_values", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(props ->> '$.k' AS INT) AS k FROM events")
sql("regex_values", "SELECT p_partkey, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS n, regexp_replace(p_name, '[aeiou]', '') AS c FROM part", "SELECT p_partkey, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS n, regexp_replace(p_name, '[aeiou]', '', 'g') AS c FROM part")
sql("array_values", "SELECT p_partkey, size(split(p_name, ' ')) AS n, element_at(split(p_name, ' '), 1) AS first FROM part", "SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS INT) AS n, string_split(p_name, ' ')[1] AS first FROM part")
sql("lag_lead", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events")


@frame("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    return streams.tumbling(tables(spark, sf_dir, "events")[0])


@frame(
    "WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),"
    " s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS i FROM e)"
    " SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, i"
)
def stream_sessions(spark, sf_dir):
    return streams.sessions(tables(spark, sf_dir, "events")[0])
