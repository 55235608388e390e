"""Places in one global order, and sums of all that comes before, without one task seeing all rows.

Rows are range-partitioned and sorted; each partition counts and adds up its own rows; the running sums over the
partitions (a row per partition) are what each partition starts from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Rows of one range partition.
ROWS = 100_000


def placed(df: DataFrame, order: list[Column], weight: Column | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with ``place`` (from 1) in the order given, and with a ``weight`` also ``before``, the sum of the
    weights of all rows in front. The order should be total: tied rows share no place, but which
    gets which is open. The sorted rows are written once, so their places stay as they are."""
    keyed = df.select("*", *[c.alias(f"__k{i}") for i, c in enumerate(order)], (F.lit(0) if weight is None else weight).cast("long").alias("__w"))
    by = [f"__k{i}" for i in range(len(order))]
    if parts is None:
        parts = max(1, min(df.count() // 1000, max(df.sparkSession.sparkContext.defaultParallelism, df.count() // ROWS)))
    at = keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id()).drop(*by)
    at = at.withColumn("__part", F.shiftright("__id", 33)).withColumn("__row", F.col("__id").bitwiseAND((1 << 33) - 1))  # of partition << 33 | row
    at = written(at.drop("__id"), "ranked")
    own = at.groupBy("__part").agg(F.count("*").alias("__n"), F.sum("__w").alias("__s"))
    w = Window.orderBy("__part")  # a row for each partition
    start = own.select("__part", (F.sum("__n").over(w) - F.col("__n")).alias("__n0"), (F.sum("__s").over(w) - F.col("__s")).alias("__s0"))
    out = at.join(F.broadcast(start), "__part").withColumn("place", F.col("__n0") + F.col("__row") + 1)
    if weight is not None:
        inside = Window.partitionBy("__part").orderBy("__row")  # at most one partition's rows
        out = out.withColumn("before", F.col("__s0") + F.sum("__w").over(inside) - F.col("__w"))
    return out.drop("__part", "__row", "__w", "__n0", "__s0")
