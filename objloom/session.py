"""A session with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "objloom", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, runtime bloom filters and UTC; small Arrow batches, since objects may be large."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
