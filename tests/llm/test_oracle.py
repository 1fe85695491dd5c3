"""Every query of this folder with SQL against DuckDB; the others give rows."""

import duckdb
import pytest

from pairjudge.llm.queries import ORACLE, QUERIES
from pairjudge.sources.tables import TABLES
from tools.oracle_check import close, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_sql(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[key](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(ORACLE[key])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    a = rows_of([r.asDict() for r in df.collect()], cols)
    b = rows_of([dict(zip(names, r)) for r in res.fetchall()], cols)
    assert len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))


DOCUMENTS = {"op1_secrets", "op4_language", "op5_simhash", "op6_surrogates", "op8_repeated_spans", "op9_decontamination"}


@pytest.mark.parametrize("key", sorted(DOCUMENTS))
def test_one_row_per_document(spark, key):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in QUERIES[key](spark, SF).select("doc_id").collect()) == ids
