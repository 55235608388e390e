"""A Spark session with what the engine needs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch: Spark's own 10,000 rows and 64 MiB, held several times over by each worker of a
#: task, make Python grow with the rows of a partition.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("marginalia")
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        **conf,
    }.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    on_workers(spark)
    return spark


def on_workers(spark: SparkSession) -> None:
    """Bound Arrow batches; let local workers import this package from the driver's tree (clusters: ``--py-files``)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
