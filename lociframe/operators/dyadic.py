"""Union, gaps and covered length of integer intervals by canonical dyadic blocks.

Each half-open interval is decomposed into its canonical dyadic blocks (aligned, of power-of-two
length). The tree over all positions is cut into three storeys: cells of ``CELL_BITS``, ranges of cells, and
the ranges of a key. A block is a node of the small tree of its storey (root 1, children 2c and 2c+1), so a
group is a set of node numbers whose size is bounded by that tree, not by the rows: copies and nested
intervals collapse in the map-side part of ``collect_set``. Per group, blocks covered by an ancestor are
removed and sibling pairs merged upward. Blocks longer than a cell cover whole cells and are handed down to
them; cells that came out full are lifted to the tree over the cells of their range and merged there. What
is left are disjoint runs inside ranges, which are coalesced by two windows over (start, end): one within
a range, one over the first and the last run of every range of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.session import cut_lineage

BITS = 40
ORIGIN = -(2 ** (BITS - 1))
CELL_BITS = 14
RANGE_BITS = 24


def tree_blocks(df: DataFrame, start: Column, end: Column, low: int, high: int) -> DataFrame:
    """One row per canonical block of ``[start, end)`` on levels ``low`` up to ``high`` - 1, as
    ``__level`` and ``__index``; both bounds are offsets from ``ORIGIN``."""
    leveled = df.withColumns({"__s": start, "__e": end}).withColumn(
        "__level", F.explode(F.expr(f"sequence({low}, least({high - 1}, greatest({low}, length(bin(__e - __s)) - 1)))"))
    )
    ends = leveled.withColumns({
        "__a": F.expr("shiftright(__s + shiftleft(1L, __level) - 1, __level)"),
        "__b": F.expr("shiftright(__e, __level)"),
    })
    left = F.expr("if(__a % 2 = 1 and __a < __b, __a, null)")
    right = F.expr("if(__b % 2 = 1 and __a + __a % 2 < __b, __b - 1, null)")
    return ends.withColumn("__index", F.explode(F.array(left, right))).filter("__index is not null").drop("__s", "__e", "__a", "__b")


def merge_tree_nodes(group: np.ndarray, node: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coalesced runs ``(group, start, end)`` of tree nodes, over many groups at once."""
    level = depth - np.frexp(node.astype(np.float64))[1].astype(np.int64) + 1
    size = np.int64(1) << level
    begin = (node - (np.int64(1) << (depth - level))) << level
    order = np.lexsort((-size, begin, group))
    group, begin, size, level = group[order], begin[order], size[order], level[order]
    # covered by an ancestor: blocks nest or are disjoint, so the furthest end so far tells
    stop = (group << (depth + 1)) + begin + size
    before = np.concatenate(([np.int64(-1)], np.maximum.accumulate(stop)[:-1])) if len(stop) else stop
    keep = stop > before
    group, begin, level = group[keep], begin[keep], level[keep]
    # sibling pairs, upward
    flat = (group << (depth + 1)) + begin
    done_flat, done_level = [], []
    here = flat[level == 0]
    for lv in range(depth + 1):
        if len(here) > 1 and lv < depth:
            even = (here[:-1] >> lv) & 1 == 0
            pair = even & (here[1:] == here[:-1] + (1 << lv))
            first = np.concatenate((pair, [False]))
            alone = ~(first | np.concatenate(([False], pair)))
            parents, rest = here[first], here[alone]
        else:
            parents, rest = here[:0], here
        done_flat.append(rest)
        done_level.append(np.full(len(rest), lv, dtype=np.int64))
        here = np.sort(np.concatenate((parents, flat[level == lv + 1])))
    flat, level = np.concatenate(done_flat), np.concatenate(done_level)
    order = np.argsort(flat, kind="stable")
    flat, until = flat[order], flat[order] + (np.int64(1) << level[order])
    # adjacent blocks; a group's domain ends half way to the next one's, so runs never cross groups
    opens = np.concatenate(([True], flat[1:] != until[:-1])) if len(flat) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(opens)
    close = np.concatenate((at[1:], [len(flat)])) - 1 if len(at) else at
    mask = (np.int64(1) << (depth + 1)) - 1
    owner = flat[at] >> (depth + 1)
    return owner, flat[at] & mask, until[close] - (owner << (depth + 1))


def _runs_of(depth: int):
    """Arrow mapper: column ``__nodes`` becomes ``__starts`` and ``__ends``, leaves of the tree counted from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column(batch.schema.names.index("__nodes"))
            counts = np.diff(nodes.offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows, dtype=np.int64), counts)
            owner, begin, until = merge_tree_nodes(owner, nodes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), depth)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=batch.num_rows)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, type=pa.int64())) for x in (begin, until)]
            kept = [n for n in batch.schema.names if n != "__nodes"]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(n)) for n in kept] + lists, names=[*kept, "__starts", "__ends"])

    return run


def _merged(nodes: DataFrame, group: list[str], depth: int) -> DataFrame:
    """Rows (``group``, ``__node``) to the runs of leaves of each group: ``group``, ``__first``, ``__until``."""
    sets = nodes.groupBy(*group).agg(F.collect_set("__node").alias("__nodes"))
    kinds = ", ".join(f"{g} {sets.schema[g].dataType.simpleString()}" for g in group)
    runs = sets.mapInArrow(_runs_of(depth), f"{kinds}, __starts array<bigint>, __ends array<bigint>")
    return runs.select(*group, F.explode(F.arrays_zip("__starts", "__ends")).alias("r")).select(*group, F.col("r.__starts").alias("__first"), F.col("r.__ends").alias("__until"))


def _node(top: int) -> Column:
    """Number of block (``__level``, ``__index``) in the tree whose root has level ``top``."""
    return F.expr(f"cast(shiftleft(1L, {top} - __level) + (__index & (shiftleft(1L, {top} - __level) - 1)) as int)")


def _group_of(top: int) -> Column:
    return F.expr(f"shiftright(__index, {top} - __level)")


def cell_runs(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Disjoint covered runs: ``__key`` (a struct), ``__range``, ``__s`` and ``__e``, counted from ``ORIGIN``.

    A run lies in one range, and in one cell unless it is made of full cells. Rows with a null bound or with start >=
    end cover nothing and are left out; a null key is a key of its own. Bounds beyond ``ORIGIN`` either way
    are an error.
    """
    valid = df.select(
        F.struct(F.col(key).alias("k")).alias("__key"),
        (F.col(start).cast("bigint") - F.lit(ORIGIN)).alias("__from"),
        (F.col(end).cast("bigint") - F.lit(ORIGIN)).alias("__to"),
    ).filter("__from < __to")
    if df.schema[start].dataType.simpleString() == "bigint" or df.schema[end].dataType.simpleString() == "bigint":
        inside = F.expr(f"__from >= 0 and __to <= {1 << BITS}")
        valid = valid.withColumn("__from", F.when(inside, F.col("__from")).otherwise(F.raise_error(F.lit(f"interval beyond {-ORIGIN} either way")).cast("bigint")))
    small = tree_blocks(valid, F.col("__from"), F.col("__to"), 0, CELL_BITS).select("__key", _group_of(CELL_BITS).alias("__cell"), _node(CELL_BITS).alias("__node"))
    long = valid.filter(f"__to - __from >= {1 << CELL_BITS}")
    middle = tree_blocks(long, F.col("__from"), F.col("__to"), CELL_BITS, RANGE_BITS).select("__key", _group_of(RANGE_BITS).alias("__range"), _node(RANGE_BITS).alias("__node"))
    top = tree_blocks(long.filter(f"__to - __from >= {1 << RANGE_BITS}"), F.col("__from"), F.col("__to"), RANGE_BITS, BITS + 1).select("__key", _node(BITS).alias("__node"))
    width = RANGE_BITS - CELL_BITS
    cells_of = lambda runs, first, until: runs.select("__key", F.explode(F.sequence(first, until - 1)).alias("__cell"), F.lit(1).alias("__node"))
    base = F.shiftleft("__range", width)
    by_middle = cells_of(_merged(middle, ["__key", "__range"], width), base + F.col("__first"), base + F.col("__until"))
    by_top = cells_of(_merged(top, ["__key"], BITS - RANGE_BITS), F.shiftleft("__first", width), F.shiftleft("__until", width))
    runs = _merged(small.unionByName(by_middle).unionByName(by_top), ["__key", "__cell"], CELL_BITS)
    runs = cut_lineage(runs)  # full cells and the others are taken from it
    full = F.col("__until") - F.col("__first") == 1 << CELL_BITS
    lifted = _merged(runs.filter(full).select("__key", F.shiftright("__cell", width).alias("__range"), F.expr(f"cast({1 << width} + (__cell & {(1 << width) - 1}) as int)").alias("__node")), ["__key", "__range"], width)
    at = lambda cell, within: F.shiftleft(cell, CELL_BITS) + within
    partly = runs.filter(~full).select("__key", F.shiftright("__cell", width).alias("__range"), at(F.col("__cell"), F.col("__first")).alias("__s"), at(F.col("__cell"), F.col("__until")).alias("__e"))
    return partly.unionByName(lifted.select("__key", "__range", at(base + F.col("__first"), F.lit(0)).alias("__s"), at(base + F.col("__until"), F.lit(0)).alias("__e")))


def coalesced(pieces: DataFrame, keys: list[str], part: str, start: str, end: str) -> DataFrame:
    """Runs (``keys``, ``start``, ``end``) of pieces that overlap or touch, each of which lies in one ``part`` of its
    keys (parts are numbered in the order of positions).

    One window merges within a part; the first and the last run of every part then meet in a window over
    the keys, so that no key gathers more than two rows a part.
    """
    inner = Window.partitionBy(*keys, part).orderBy(start, end)
    before = F.max(end).over(inner.rowsBetween(Window.unboundedPreceding, -1))
    opens = pieces.select(*keys, part, start, end, F.when(before >= F.col(start), 0).otherwise(1).alias("__opens")).withColumn("__run", F.sum("__opens").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    runs = opens.groupBy(*keys, part, "__run").agg(F.min(start).alias(start), F.max(end).alias(end)).withColumn("__last", F.max("__run").over(Window.partitionBy(*keys, part)))
    edge = (F.col("__run") == 1) | (F.col("__run") == F.col("__last"))
    outer = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(outer.rowsBetween(Window.unboundedPreceding, -1))
    # a part's last run that is not its first never touches its first, so no inner run is passed over
    edges = runs.filter(edge).select(*keys, start, end, F.when(reach >= F.col(start), 0).otherwise(1).alias("__opens")).withColumn("__run", F.sum("__opens").over(outer.rowsBetween(Window.unboundedPreceding, 0)))
    met = edges.groupBy(*keys, "__run").agg(F.min(start).alias(start), F.max(end).alias(end))
    return runs.filter(~edge).select(*keys, start, end).unionByName(met.select(*keys, start, end))


def interval_gaps(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Longest uncovered stretches between the smallest start and the largest end of each key.

    Columns: the key, ``gap_start``, ``gap_end`` (half-open). Touching intervals leave no gap, nested and
    repeated ones change nothing, and a key with one stretch has no row. Rows with a null bound or start
    >= end are ignored, a null key is a key of its own, other columns are not read. Bounds beyond 2**39
    either way are an error.
    """
    runs = cell_runs(df, key, start, end)
    inner = Window.partitionBy("__key", "__range").orderBy("__s")
    near = runs.select("__key", "__range", "__s", F.lag("__e").over(inner).alias("__p"), F.max("__e").over(Window.partitionBy("__key", "__range")).alias("__l"))
    firsts = near.filter("__p is null").withColumn("__p", F.lag("__l").over(Window.partitionBy("__key").orderBy("__range")))  # one row a range
    gaps = near.filter("__p < __s").unionByName(firsts.filter("__p < __s"))
    kind = df.schema[start].dataType
    return gaps.select(F.col("__key.k").alias(key), (F.col("__p") + ORIGIN).cast(kind).alias("gap_start"), (F.col("__s") + ORIGIN).cast(kind).alias("gap_end"))


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Continuous covered stretches of each key: the key, ``stretch_start``, ``stretch_end``.

    Same treatment of nulls, empty and repeated intervals as :func:`interval_gaps`.
    """
    whole = coalesced(cell_runs(df, key, start, end), ["__key"], "__range", "__s", "__e")
    kind = df.schema[start].dataType
    return whole.select(F.col("__key.k").alias(key), (F.col("__s") + ORIGIN).cast(kind).alias("stretch_start"), (F.col("__e") + ORIGIN).cast(kind).alias("stretch_end"))


def covered_lengths(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Covered positions of each run (``key``, ``covered``): partial states, to be added up by a tree
    aggregation."""
    return cell_runs(df, key, start, end).select(F.col("__key.k").alias(key), (F.col("__e") - F.col("__s")).alias("covered"))
