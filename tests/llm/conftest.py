import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_rows import EDGE, SF  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame([(*r, "keep", 1, "row") for r in EDGE],
                                 "doc_id long, text string, source string, n_chars long, keep_id string, size long, __row string")


@pytest.fixture(scope="session")
def nothing(spark, edge):
    return edge.filter("doc_id < 0")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r for r in docs.collect()}
