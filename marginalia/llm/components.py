"""Connected components of an edge table, by alternating large-star and small-star steps.

All state is a table in the shared scratch folder; nothing is collected. A node with very many
edges is no hot spot: minima are combined before the shuffle, and the written table of minima
meets the edges in an equi-join that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _minima(e: DataFrame) -> DataFrame:
    return materialize(e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima")


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u long, v long) to (node, label): label is the smallest node reachable."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, "edges")
    while True:
        before = _state(e)
        if before[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: each larger neighbour of u is linked to u's smallest neighbour
        large = both.join(_minima(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        # small star: u and its smaller neighbours are linked to the smallest of them
        low = _minima(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = materialize(small.where("u <> v").distinct(), "edges")
        if _state(e) == before:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def _state(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")).first()
    return r.n, r.h
