"""Session factory and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "civicspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` overrides any setting.

    Nothing about parallelism is fixed here: on a cluster the submit-time settings rule.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Only a local master, where all share one disk, may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="civicspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is ever overwritten."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back.

    The copy survives lost executors, and its known size lets small tables be broadcast by the optimizer.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_PER_PART = 524_288


def parts_for(rows: int) -> int:
    """Partitions that hold ``ROWS_PER_PART`` of ``rows`` each."""
    return -(-rows // ROWS_PER_PART)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal about ``rows`` rows by ``keys`` to as many partitions as they need, so that a task's rows don't grow with the table.

    Where the session's own number of partitions is enough, nothing moves: the optimizer deals as it sees fit. Tables dealt by the same
    key and ``rows`` lie alike. What groups or joins by ``keys`` (and more columns, when it groups) needs no further exchange.
    """
    parts = parts_for(rows)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
