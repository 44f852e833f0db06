"""Tables of blocks that several passes read without moving them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from stratalens.session import shared_folder


def stored(df: DataFrame, parts: int) -> DataFrame:
    """``df`` (block, ...) as a table divided by block in the shared folder; what is joined or cogrouped by block comes to it."""
    spark = df.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, "block").option("path", f"{shared_folder(spark).rstrip('/')}/{name}").saveAsTable(name)
    out = spark.table(name).select(*df.columns)
    spark.sql(f"DROP TABLE {name}")  # the name only: the plan is resolved, and the files of an external table stay
    return out
