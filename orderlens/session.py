"""Session settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Day arithmetic and period labels must not move with the machine's clock.
    "spark.sql.session.timeZone": "UTC",
    # Re-plan at run time: coalesce small shuffles, split skewed joins, and
    # broadcast only what has been measured to be small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Wide projections: beyond this size the JVM would interpret generated code, so let
    # Spark generate it in smaller pieces instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Column expressions need not remember their Python call site.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Checkpoints are removed once nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Bad input must surface as NULL through try_* functions, never silently.
    "spark.sql.ansi.enabled": "true",
}


def build_session(app: str = "orderlens", master: str | None = None, **extra: str) -> SparkSession:
    """Create (or reuse) a session; ``extra`` settings win over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
