"""A session with the settings that results depend on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "timelens", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, Arrow, and RocksDB state for streams; more settings by keyword."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpoint(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut in the shared folder of ``spark.checkpoint.dir``; only a single machine may lack that setting."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()
