"""A session with the settings that the engine's plans want; cluster settings given elsewhere win."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.speculation": "false",  # a second attempt of a model call would be paid for twice
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("quirefold")
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
