"""Per-key results without a hot reducer: multi-level tree aggregation.

Every input split is one fixed-size chunk. Its rows are combined inside the task that reads it, which
leaves one state per key and chunk. The states then climb a tree: in each round at most ``fan_in``
chunks of one key meet in one group, so no task ever receives all the partial states of a hot key,
however many rows the key holds. The depth comes from the number of partitions that the frame has; there
are two rounds at least.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}
_NODE = "__tree_node"


def partition_count(df: DataFrame) -> int:
    """Partitions of ``df``: counted for frames that only scan, which runs nothing; for frames with a shuffle
    the most that it can make."""
    if "Exchange" not in df._jdf.queryExecution().sparkPlan().toString() and not any(x in df._jdf.queryExecution().optimizedPlan().toString() for x in ("Aggregate", "Join", "Window", "Sort", "Repartition", "Limit")):
        return df.rdd.getNumPartitions()
    conf = df.sparkSession.conf
    first = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return max(int(conf.get("spark.sql.shuffle.partitions")), int(first or 0))


def tree_rounds(total: int, fan_in: int) -> int:
    """Rounds until the states of ``total`` chunks have become one, two at least."""
    rounds, reach = 1, fan_in
    while reach < total:
        rounds, reach = rounds + 1, reach * fan_in
    return max(2, rounds)


def tree_aggregate(df: DataFrame, keys: list[str], states: Mapping[str, tuple[str, Column]], fan_in: int = 8, chunks: int | None = None) -> DataFrame:
    """Aggregate ``states`` per ``keys`` in rounds of ``fan_in``.

    ``states`` maps an output name to ``(merge, expression)`` with merge one of sum, min and max;
    a row count is ``("sum", F.lit(1))``. ``chunks`` is the number of partitions, :func:`partition_count` without
    it. Partitions beyond it, as a skew split may make them, share the nodes of others.

    Null keys form a group of their own, null values are ignored as by the built-in aggregates, and an
    empty input gives an empty result. Other columns of ``df`` are left out.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    total = partition_count(df) if chunks is None else chunks
    rounds = tree_rounds(total, fan_in)
    inner = [f"__key_{i}" for i in range(len(keys))]
    named = {f"__state_{i}": (name, *spec) for i, (name, spec) in enumerate(states.items())}
    level = df.select(
        *[F.col(k).alias(i) for k, i in zip(keys, inner)],
        *[expr.alias(s) for s, (_, _, expr) in named.items()],
        F.pmod(F.spark_partition_id(), F.lit(max(1, total))).alias(_NODE),
    )
    for n in range(rounds):
        last = n == rounds - 1
        node = [] if last else [F.expr(f"{_NODE} div {fan_in}").alias(_NODE)]
        level = level.groupBy(*inner, *node).agg(*[_MERGE[how](s).alias(s) for s, (_, how, _) in named.items()])
    return level.select(*[F.col(i).alias(k) for k, i in zip(keys, inner)], *[F.col(s).alias(name) for s, (name, _, _) in named.items()])
