"""The session that the engine's queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: caseSensitive: identifiers of the dialect are. ANSI stays on: bad casts are errors, as they are on load.
SETTINGS = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(master: str = "local[*]", shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("granary").config(map=SETTINGS | more)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
