"""Catalog queries against their SQL in DuckDB, and the entry module."""

import duckdb
import pytest

from quernstone.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()
NAMES = "p2_exact p5_contains p6_membership s3_hash_skip s8_notes_in_order m7_kv_upsert m8_kv_delete m12_slice_changes b5_word_scores d1_compare_nodes r4_budget t2_debounce t7_coalesce b12_incremental b7_boosted_search m1_node_upsert m2_edge_log".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_sql(spark, duck, name):
    done = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in done.description]
    wanted = done.fetchall()
    rows = catalog.queries()[name](spark, SF).select(*columns).collect()
    plain = lambda r: repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r))
    assert sorted(map(plain, rows)) == sorted(map(plain, wanted))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "type", "name", "acctbal"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
