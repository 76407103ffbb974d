"""JSON documents of a bounded number of rows: every row once, however many documents."""

import json

from pyspark.sql import functions as F

from tabloom.catalog import files
from tabloom.sources.readers import read_json


def test_larger_tables_are_more_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "DOCUMENT_ROWS", 100)
    df = spark.range(1_050).select("id", F.when(F.col("id") % 3 == 0, F.lit('a "b",\n]')).alias("t"))
    path = str(tmp_path / "rows.json")
    files._write_documents(df, path)
    parts = [json.loads(p.read_text()) for p in (tmp_path / "rows.json").glob("part-*")]
    assert len(parts) == 11 and max(map(len, parts)) <= 110
    back = read_json(spark, path)
    assert back.exceptAll(df.select(back.columns)).isEmpty() and back.count() == 1_050
