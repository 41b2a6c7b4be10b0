"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.session import cut_lineage

SALTS = 8


def _least(edges: DataFrame) -> DataFrame:
    """Per node ``u`` the least node among itself and its neighbours ``v``; combined before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _pointed(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with ``m`` of their ``u``; a hub's edges spread over salted partitions."""
    salted = least.withColumn("s", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    return edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["u", "s"]).drop("s")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``node`` and ``component`` (its least node) of every node of ``edges`` (``u``, ``v``, bigint).

    Edges may repeat and go either way; loops alone make no node. Every round writes the edges anew with
    a checkpoint and ends when they no longer change; their number falls or stays. More than
    ``max_rounds`` rounds are an error.
    """
    now = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _pointed(both, _least(both)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut_lineage(large)
        least = _least(large)
        small = _pointed(large, least).select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        now = cut_lineage(small)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        state = seen
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
