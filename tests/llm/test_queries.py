import glob
import os

import duckdb
import pandas as pd
import pytest

from tests.conftest import DATA, rows
from tickloom.llm import queries


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    def plain(df):
        df = df[sorted(df.columns)].copy()
        for c in df.columns:
            if str(df[c].dtype).startswith("datetime"):
                df[c] = df[c].astype("datetime64[us]")
        return df.sort_values(list(df.columns), ignore_index=True)

    got, want = plain(queries.queries()[name](spark, DATA).toPandas()), plain(duck.execute(queries.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)


def test_queries_run(spark):
    q = queries.queries()
    leaks = q["p6_found"](spark, DATA)
    assert leaks.columns == ["doc_id", "item_id"] and leaks.count() == leaks.distinct().count()
    assert q["p7_found"](spark, DATA).columns == ["source"]
    report = {r.source: r for r in q["p7_report"](spark, DATA).collect()}
    assert {s for s, r in report.items() if r.short} == {r[0] for r in rows(q["p7_found"](spark, DATA))}
    assert q["p7_mix"](spark, DATA).count() > 0
    subjects = q["p8_found"](spark, DATA)
    assert subjects.columns == ["doc_id", "subject"] and subjects.count() > 0
