"""Session settings that the engine expects."""
from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    b = SparkSession.builder.appName("nestflow")
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **settings}.items():
        b = b.config(k, v)
    return b.getOrCreate()
