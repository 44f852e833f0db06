import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]

from samples import ODD, SF  # noqa: E402


@pytest.fixture(scope="session")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(0) for c in ("row", "n", "start", "kind", "b", "_row", "kept", "score", "first", "keep", "_found_id", "_spans", "_id", "_key", "_found_key", "sentences", "given", "key", "id", "found_id",
                                       "found_key", "spans", "text_key", "hit")})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
