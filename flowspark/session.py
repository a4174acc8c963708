"""Spark settings the jobs are tuned for; all others stay at their defaults."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    # Calendar rules and window labels must not depend on the machine's zone.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: partition coalescing, and splits of hot join partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM does not compile methods above 8,000 bytes of bytecode. A stage that
    # exceeds this runs several times faster operator by operator than interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Run jobs with the method limit above, also in a session that was not configured with it."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, SETTINGS[name])
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
