import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def documents(spark, sf):
    """The smallest documents table, as Spark rows and as a list by id."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs, sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
