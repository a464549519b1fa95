"""Sessions with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC everywhere, adaptive plans with skew joins, map overlays where the right-most key wins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "tessera", master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    """A session; master and partitions are left to the cluster's configuration unless given."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | more)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()
