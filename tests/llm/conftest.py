import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from edge_rows import CLASHING, benchmark_items, edge_documents, label_rows, pages_rows  # noqa: E402

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Folders with edge cases and with nothing in them."""
    from pyspark.sql import functions as F

    rows = edge_documents()
    out = {}
    for name, docs, items, pages in (("edge", rows, benchmark_items(rows), pages_rows()), ("empty", [], [], [])):
        d = tmp_path_factory.mktemp(name)
        extra = {c: F.lit("clash") for c in CLASHING}
        spark.createDataFrame(docs, DOCS).withColumns(extra).repartition(3).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("words", "terms", "item")}).write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("digest", "shard", "refers_to", "is_verdict", "size")}).write.parquet(f"{d}/pages.parquet")
        labels = label_rows() if docs else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit(9) for c in ("weight", "source", "size", "key")}).write.parquet(f"{d}/labels.parquet")
        out[name] = str(d)
    return out


@pytest.fixture(scope="session")
def docs():
    return edge_documents()
