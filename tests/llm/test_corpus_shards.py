"""Items in several shards: the same scores as in one."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from tabloom.llm import decontaminate


def found(docs, items):
    return sorted(
        (r.doc_id, r.item_id, round(r.score, 12), r.question_overlap, r.answer_overlap)
        for r in decontaminate.find_leaks(docs, items).collect()
    )


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(400)
    own = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # Items cut out of documents, of very different lengths, so that the mean length differs from shard to shard.
    cut = docs.filter("doc_id % 23 = 0").select(
        (F.col("doc_id") + 1_000_000).alias("item_id"),
        F.array_join(F.slice(F.split("text", " "), 3, (F.col("doc_id") % 60 + 8).cast("int")), " ").alias("text"),
    )
    items = decontaminate.split_items(own.select("item_id", "text").limit(60).unionByName(cut)).cache()
    return docs.cache(), items


def test_shards_change_nothing(spark, tables, monkeypatch):
    docs, items = tables
    whole = found(docs, items)
    assert len(whole) > 5
    size = items.agg(F.sum(F.octet_length("question") + F.octet_length("answer"))).first()[0]
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", -(-size // 4))
    shards = list(decontaminate._shards(items, decontaminate.THRESHOLD))
    assert len(shards) == 4 and sum(len(s.index.items) > 0 for s in shards) > 1
    assert len({(s.index.longest, len(s.index.vocabulary) > 0) for s in shards if s.index.items}) == 1
    assert found(docs, items) == whole
    marked = decontaminate.with_leaks(docs, items).filter("n_leaks > 0").select("doc_id", "n_leaks").collect()
    assert {r.doc_id: r.n_leaks for r in marked} == {d: sum(w[0] == d for w in whole) for d in {w[0] for w in whole}}


def test_shards_of_repeated_null_and_empty_items(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h i"), (2, None), (3, "")], "doc_id int, text string")
    rows = [(7, "a b c d e f", "g h")] * 3 + [(8, None, "g"), (8, "", "g"), (None, "", None), (9, "", "")]
    items = spark.createDataFrame(rows, "id int, question string, answer string")
    whole = found(docs, items)
    assert [w[:2] for w in whole] == [(1, 7), (1, 8)]
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 5)
    assert found(docs, items) == whole


@pytest.mark.parametrize("ids", [
    ("date", datetime.date(2020, 2, 3)), ("decimal(20,4)", decimal.Decimal("12.5000")), ("string", "x"), ("smallint", 3),
    ("timestamp", datetime.datetime(2020, 2, 3, 4, 5)), ("struct<a:int,b:string>", (1, "k")),
])
def test_ids_of_any_type(spark, ids):
    kind, value = ids
    docs = spark.createDataFrame([(value, "one two three four five six seven")], f"doc_id {kind}, text string")
    items = spark.createDataFrame([(value, "one two three four five", "six seven")], f"id {kind}, question string, answer string")
    row = decontaminate.find_leaks(docs, items).first()
    assert row.item_id == row.doc_id == (value if kind[:6] != "struct" else row.doc_id)
