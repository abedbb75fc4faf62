import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_flagship(spark):
    assert e.entry(spark).count() == 2


def test_each_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100
    assert e._llm is None or {f"op{i}" for i in range(1, 14)} <= {k.split("_")[0] for k in e.queries()}


@pytest.mark.parametrize("name", ["a03_auroc", "a08_avg_precision", "a17_worst_family", "b05_select_threshold", "j10_near_dup_pairs", "u06_clusters", "f01_row_violations", "f16b_all_reasons", "p05_vector38", "q02_varlap8"])
def test_some_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = e.queries()[name](spark, SF)
    want = con.sql(e.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
