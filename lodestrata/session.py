"""Session settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "lodestrata", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution and ANSI mode; ``settings`` go over the defaults."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
    } | {k.replace("__", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()
