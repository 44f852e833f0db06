"""Session set-up and durable intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}


def get_session(app: str = "stratalens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and skew handling on; settings that the cluster or the caller gives win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {k.replace("__", "."): v for k, v in conf.items()}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    given = dict(spark.sparkContext.getConf().getAll())
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # The JVM leaves methods over 8000 bytes uncompiled; wide ratio projections run split instead.
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }
    for key, value in defaults.items():
        if key not in given:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for durable intermediates: ``spark.checkpoint.dir`` of the session.

    A local session without the setting gets a fresh temporary folder; a cluster session must name one, because a
    folder of one machine cannot be read by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="stratalens-")
    return _LOCAL_FOLDERS[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several passes follow (exact quantiles, refits): the passes read only the columns they need from the
    table, and the loss of an executor does not bring the upstream joins back.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> DataFrame:
    """A small aggregate, stored so that Spark knows how large it is before it plans a join with it.

    Under the session's broadcast threshold the join leaves the large side where it is; above it Spark shuffles. An
    unstored aggregate has no known size, and adaptive execution only finds it out after moving the large side.
    """
    return materialize(df)
