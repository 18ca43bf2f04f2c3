"""A session with the settings that the plans assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "trackloom", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Adaptive execution with skew handling, Arrow, UTC. Partitions default to the cluster's own setting."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    builder = builder.master(master) if master else builder
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)) if partitions else builder
    return builder.getOrCreate()
