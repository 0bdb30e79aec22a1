import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as e
from gradeloom.llm import queries

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["qa_id_a", "qa_id_b"],
    "p2_found": ["cluster_id", "qa_id"],
    "p3_found": ["context_id", "noise", "item"],
    "p4_found": ["pair_id", "field_name", "pos", "defect"],
    "p5_found": ["label", "domain_name"],
    "p6_ids": ["doc_id", "ids"],
    "p7_found": ["doc_id"],
    "p8_found": ["doc_id", "subject"],
}
OTHERS = ["p3_paragraphs", "p5_sample", "p5_residuals", "p7_packing", "p7_fill", "p8_composition"]


@pytest.mark.parametrize("name", COLUMNS)
def test_found_has_the_columns_of_testdata(spark, name):
    df = e.queries()[name](spark, SMALL)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert rows and len(rows) == df.distinct().count()


@pytest.mark.parametrize("name", OTHERS)
def test_others_give_rows(spark, name):
    assert e.queries()[name](spark, SMALL).count()


def test_every_document_has_ids(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").distinct()
    got = e.queries()["p6_ids"](spark, SMALL)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in docs.collect())


@pytest.mark.parametrize("name", queries.SQL)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SMALL):
        db.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM read_parquet('{SMALL}/{f}')")
    df = e.queries()[name](spark, SMALL)
    cursor = db.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(str([r[c] for c in names]) for r in df.collect()) == sorted(str(list(r)) for r in cursor.fetchall())
