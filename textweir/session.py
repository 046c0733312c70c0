"""A session with the settings the library is meant for."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the session's folder. Only a local session without one gets its own."""
    sc = df.sparkSession.sparkContext
    if not (sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")):
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="textweir-"))
    return df.checkpoint()


def session(app: str = "textweir", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; anything in ``conf`` wins. Partition counts stay the cluster's own."""
    b = SparkSession.builder.appName(app)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true"}
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
