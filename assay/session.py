"""Session factory with the settings that the operators' semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Fixed by semantics: zone-less timestamps, strict errors, case-insensitive names.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "false",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def create_session(app_name: str = "assay", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with SEMANTICS; ``conf`` adds to or replaces single settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SEMANTICS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

