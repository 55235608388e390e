"""What the training-data operators share: tables, shared scratch space, Arrow limits."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder that holds the top-level package; workers on this host import it from here.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Arrow batches handed to Python stay under these bounds, however long the rows.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches and let local workers import this package from the driver's tree.

    On a cluster without a shared tree, ship the package with ``--py-files``.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def scratch_base(spark: SparkSession) -> str | None:
    """The shared folder that the session names for checkpoints, if it names one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and (own := sc._jsc.sc().getCheckpointDir()).isDefined():
        named = own.get()
    return named.rstrip("/") if named else None


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path in the shared folder. A local one is made only in local mode."""
    base = scratch_base(spark)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="marginalia-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/marginalia/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


class _Written(threading.local):
    """Paths of the tables written here, in order; each thread has its own, so runs side by side do not
    delete each other's tables."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __getitem__(self, at):
        return self.paths[at]

    def __len__(self) -> int:
        return len(self.paths)


_WRITTEN = _Written()


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: the lineage ends there,
    so a lost executor costs a re-read and not a recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}"
    df.write.parquet(path)
    _WRITTEN.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        if (files := df.inputFiles()) and f"/marginalia/{spark.sparkContext.applicationId}/" in files[0]:
            _delete(spark, os.path.dirname(os.path.dirname(files[0])))


def written() -> int:
    """A mark for :func:`discard_since`."""
    return len(_WRITTEN)


def discard_since(spark: SparkSession, mark: int, keep: DataFrame | None = None) -> None:
    """Delete the tables written since a mark, but for one that is still read."""
    stay = {os.path.dirname(f) for f in keep.inputFiles()} if keep is not None else set()
    for path in _WRITTEN[mark:]:
        if not any(x.endswith(path.split(":", 1)[-1].lstrip("/")) for x in stay):
            _delete(spark, path)
            _WRITTEN.paths.remove(path)


#: Ids that may be broadcast: 8 MB.
FEW = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for a broadcast if it is known to be small; a larger one
    is left to an ordinary join."""
    return F.broadcast(ids) if ids.count() <= FEW else ids


def smallest_hashes(ids: DataFrame, kind: str, most: int) -> DataFrame:
    """At most ``most`` rows (doc_id, ``kind``) of each kind, those with the smallest hashes.

    The kinds are counted first (they are classes or languages, so few); hashes are uniform,
    so rows with a hash far above the share that is wanted are dropped before any shuffle, and
    no task gets more than a few times ``most`` rows of a kind, however large the table.
    """
    counts = ids.groupBy(kind).agg(F.count("*").alias("n")).collect()
    share = [(r[0], min(1.0, (2.0 * most + 100) / r[1])) for r in counts]
    share = ids.sparkSession.createDataFrame(share, T.StructType([ids.schema[kind], T.StructField("__share", T.DoubleType())]))
    at = F.xxhash64("doc_id")
    low = ids.join(F.broadcast(share), kind).where(at / F.lit(2.0**64) + 0.5 < F.col("__share"))
    w = Window.partitionBy(kind).orderBy(at, "doc_id")
    return low.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).select("doc_id", kind)


def drop_scratch(spark: SparkSession) -> None:
    """Delete everything that :func:`materialize` has left behind in this application."""
    if base := scratch_base(spark):
        _delete(spark, f"{base}/marginalia/{spark.sparkContext.applicationId}")


def add_columns(df: DataFrame, make, fields, keep: list[str] | None = None, needs: tuple[str, ...] = ("text",)) -> DataFrame:
    """``df`` with columns computed by Arrow batches in Python, without a shuffle.

    ``make()`` runs once per task and returns a function from a record batch (with the columns
    of ``needs``) to one array per field of ``fields``. ``keep`` names the input columns that
    are carried along (all by default); one named like a new field is replaced by it.
    """
    import pyarrow as pa

    keep = [c for c in (df.columns if keep is None else keep) if c not in fields.names]
    schema = T.StructType([df.schema[c] for c in keep] + fields.fields)
    names = schema.names

    def run(batches):
        f = make()
        for b in batches:
            old = [b.column(b.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(old + list(f(b)), names=names)

    return df.select(*dict.fromkeys([*keep, *needs])).mapInArrow(run, schema)


def utf8_of(batch, name: str = "text") -> list[bytes | None]:
    """A string column's UTF-8 bytes, without decoding."""
    import pyarrow as pa

    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()
