"""Session settings the operators were measured with."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Wide projections compile to methods above the size HotSpot is willing to optimise (8000 bytes); beyond
# this limit Spark then splits the work over operators instead of running one method interpreted.
RECOMMENDED = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
DEFAULTS = {"spark.sql.codegen.hugeMethodLimit": "65535"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the recommended runtime settings; a value the user changed from Spark's default is kept."""
    for name, value in RECOMMENDED.items():
        current = spark.conf.get(name, DEFAULTS.get(name))
        if current in (None, DEFAULTS.get(name)):
            spark.conf.set(name, value)
    return spark
