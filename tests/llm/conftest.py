from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=True):
        """Documents of (doc_id, text[, lang[, source]]) with columns that clash with those of the operators."""
        full = [(r + (None,) * 4)[:4] for r in rows]
        df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], SCHEMA)
        if extra:
            for c in ("id", "key", "size", "score", "range", "root", "copies", "kept"):
                df = df.withColumn(c, F.lit("clash"))
        return df

    return make
