"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .sources.las import LasSource

SETTINGS = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.maxRecordsPerBatch": "4096"}


def session(app: str = "terrasift", master: str | None = None, **more: str) -> SparkSession:
    """Adaptive execution, UTC, small Arrow batches; sizes of partitions are left to the cluster. Registers the las format."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.dataSource.register(LasSource)
    return spark
