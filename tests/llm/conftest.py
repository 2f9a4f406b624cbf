"""Small tables for the operators on training data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """``documents({id: text, ...})`` or pairs: a documents table; columns with clashing names
    are added."""

    def build(texts, *extra: str):
        pairs = list(texts.items()) if isinstance(texts, dict) else list(texts)
        rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in pairs]
        df = spark.createDataFrame(rows, DOCS)
        return df.withColumns({name: F.lit("x") for name in extra})

    return build


@pytest.fixture(scope="session")
def tiny(spark):
    return lambda name: spark.read.parquet(f"{TINY}/{name}.parquet")
