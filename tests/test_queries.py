import re

import compare
import pytest

from sparrowmill.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert not compare.differences(QUERIES[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n.startswith("sort_")])
def test_whole_tables_in_order(spark, con, name):
    table = "customer" if "hidden" in name else "orders"
    got = [tuple(r) for r in QUERIES[name](spark, SF).collect()]
    assert got == con.execute(ORACLES[name]).fetchall()
    assert len(got) == con.execute(f"SELECT count({'DISTINCT o_custkey' if 'aggregate' in name else '*'}) FROM {table}").fetchone()[0]


def test_whole_tables_have_unmatched_rows(spark):
    assert all(QUERIES[f"set_{n}"](spark, SF).count() for n in ("except", "except_all", "intersect", "intersect_all"))
    full = QUERIES["join_full"](spark, SF)
    assert full.where("o_orderkey IS NULL").count() and full.where("l_orderkey IS NULL").count()
    assert QUERIES["arithmetic"](spark, SF).count() == QUERIES["scan_constant"](spark, SF).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_reads_a_key_range(name):
    """Whole tables: no bound on the keys of the large ones, but for the point lookup and the scan of nothing."""
    if name not in ("scan_index_point", "agg_empty_input"):
        assert not re.search(r"[lo]_orderkey\s*(<|>|<=|>=|BETWEEN)\s*\d", ORACLES[name])
