"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(entry.catalogue.ORACLES)
FLOWS = sorted(set(entry.catalogue.QUERIES) - set(NAMES))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(names, records):
    def plain(v):
        if hasattr(v, "isoformat"):
            return v.isoformat()
        return round(v, 9) if isinstance(v, float) else v

    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(str(plain(r[k])) for k in order) for r in records)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", FLOWS)
def test_flow(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_only_flows_lack_sql():
    assert all(name.startswith("flow_") for name in FLOWS)


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "zoning_top1", "zoning_top1_pct", "zoning_top2", "zoning_top2_pct"]


def test_scan_is_pruned(spark, capsys):
    entry.queries()["contains_ci"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan
    entry.queries()["addr_between"](spark, SF).explain("formatted")
    assert "PushedFilters: [IsNotNull(c_custkey), GreaterThanOrEqual(c_custkey,40)" in capsys.readouterr().out


def test_no_cartesian_products(spark, capsys):
    for name in ("rect_join_inner", "pip_join", "zoning_top2", "pip_bidirectional"):
        entry.queries()[name](spark, SF).explain()
        plan = capsys.readouterr().out
        assert "Cartesian" not in plan and "NestedLoop" not in plan
