"""Tables written to the folder that executors share, to end a lineage or to be read by position."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in ``spark.checkpoint.dir``; only in local mode one is made where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="marginalia-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/marginalia/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def mounted_dir(spark: SparkSession) -> str:
    """The same as a path that plain file functions can open, for vaults that queries make."""
    path = shared_dir(spark)
    if "://" in path and not path.startswith("file://"):
        raise RuntimeError("a vault needs a shared folder that is mounted on all machines")
    return "/" + path.removeprefix("file:").lstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table of its own: what reads it does not compute it again."""
    path = f"{shared_dir(df.sparkSession)}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
