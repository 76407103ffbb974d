"""Queries with a SQL twin give the twin's rows; all others return every row of their table."""

import pytest
from compare import connect, difference

from tabloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_twin(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) is None


@pytest.mark.parametrize("name", ["op2_language_id", "op4_pitman_yor", "op7_fingerprints"])
def test_one_row_per_document(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = QUERIES[name](spark, sf_dir)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
