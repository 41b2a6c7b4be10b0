"""Joins and sweeps over intervals.

An interval has the level of its length, on which it meets at most two bins; so it does on every higher level.
A pair meets on the level of the longer one: queries look up data of their own and of higher levels, and data
that is shorter than some query is lifted to the levels of such queries. So long intervals do not multiply on
either side. A pair that shares two bins counts in the one that holds the later start. Both sides carry a
salt, so a bin that holds a third of the rows is spread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.functions.intervals import overlaps
from lociframe.operators.dyadic import tree_blocks
from lociframe.session import broadcast_if_small, cut_lineage

LEVELS = (14, 17, 20, 23, 26, 29, 32)
SALTS = 4
PAINT_BITS = 14
FEW_NODES = 128
LOOKUP_BITS = 8
_SHIFT = 2**31


def _level(s: str, e: str) -> Column:
    """Smallest level whose bins are as long as the interval."""
    cases = " ".join(f"when {e} - {s} < {1 << b}L then {b}" for b in LEVELS[:-1])
    return F.expr(f"case {cases} else {LEVELS[-1]} end")


def _met(queries: DataFrame, data: DataFrame, key: str, start: str, end: str, mode: str, salts: int) -> tuple[DataFrame, DataFrame, list]:
    """Both sides as rows of bins, and the conditions of their join."""
    def bounds(df: DataFrame, side: str, wide: int) -> DataFrame:
        flat = df.select(F.struct("*").alias(side), F.col(key).alias("__key"), F.col(start).alias(f"__{side}s"), F.col(end).alias(f"__{side}e"))
        return flat.filter(f"__key is not null and __{side}s <= __{side}e").withColumns({
            f"__{side}a": F.expr(f"greatest(0, __{side}s + {_SHIFT}L - {wide})"), f"__{side}b": F.expr(f"greatest(cast(__{side}s as bigint), __{side}e - 1L) + {_SHIFT}L + {wide}"),
        }).withColumn(f"__{side}l", _level(f"__{side}a", f"__{side}b"))

    def bins(side: str, levels: list[tuple[int, str, int]]) -> str:
        """Bins of those levels whose condition holds; ``way`` tells lifted data from data on its own level."""
        at = [f"if({cond}, transform(sequence(shiftright(__{side}a, {b}), shiftright(__{side}b, {b})), x -> struct({way} as way, {b} as level, x as bin)), null)" for b, cond, way in levels]
        return f"flatten(filter(array({', '.join(at)}), x -> x is not null))"

    q, d = bounds(queries, "q", 0 if mode == "strict" else 1), bounds(data, "d", 0)
    lifted = sorted(r[0] for r in q.select("__ql").distinct().collect() if r[0] > LEVELS[0])  # at most one per level
    d = d.withColumn("__p", F.explode(F.expr(bins("d", [(b, f"__dl = {b}", 0) for b in LEVELS] + [(b, f"__dl < {b}", 1) for b in lifted]))))
    d = d.withColumn("__salt", F.pmod(F.xxhash64("__ds", "__de", "d"), F.lit(salts)).cast("int"))
    q = q.withColumn("__p", F.explode(F.expr(bins("q", [(b, f"__ql <= {b}", 0) for b in LEVELS] + [(b, f"__ql = {b}", 1) for b in lifted]))))
    q = q.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    q, d = (x.select(side, f"__{side}s", f"__{side}e", f"__{side}a", F.col("__key").alias(f"__{side}k"), *[F.col(f"__p.{c}").alias(f"__{side}_{c}") for c in ("way", "level", "bin")], F.col("__salt").alias(f"__{side}t")) for side, x in (("q", q), ("d", d)))
    on = [F.col("__qk") == F.col("__dk"), F.col("__qt") == F.col("__dt"), *[F.col(f"__q_{c}") == F.col(f"__d_{c}") for c in ("way", "level", "bin")]]
    return q, d, [*on, F.expr("shiftright(greatest(__qa, __da), __q_level) = __q_bin"), overlaps(F.col("__qs"), F.col("__qe"), F.col("__ds"), F.col("__de"), mode)]


def overlap_join(queries: DataFrame, data: DataFrame, key: str = "chr", start: str = "start_pos", end: str = "end_pos", mode: str = "strict", salts: int = SALTS) -> DataFrame:
    """All (query, data) pairs that overlap, as columns ``q`` and ``d``, structs of the whole rows.

    Rows with a null key or bound or with start > end meet nothing; an empty interval overlaps what it lies
    strictly inside of (``strict``). Repeated rows pair as often as they come. Columns of the same name on
    both sides do not clash, as they stay in their structs.
    """
    q, d, on = _met(queries, data, key, start, end, mode, salts)
    return q.join(d, on).select("q", "d")


def any_overlap(queries: DataFrame, data: DataFrame, id_col: str, key: str = "chr", start: str = "start_pos", end: str = "end_pos", mode: str = "strict", salts: int = SALTS) -> DataFrame:
    """Queries that overlap at least one data row, each once per row of ``queries``. No pairs are made: the search
    for a query in a bin ends at its first overlap."""
    q, d, on = _met(queries.select(id_col, key, start, end), data.select(key, start, end), key, start, end, mode, salts)
    hit = q.join(d, on, "left_semi").select(F.col(f"q.{id_col}").alias("__hit")).distinct()
    return queries.join(hit, queries[id_col] == hit["__hit"], "left_semi")


def nearest_neighbour(queries: DataFrame, data: DataFrame, reach: int, q_id: str, d_id: str, stranded: bool = True) -> DataFrame:
    """For each query the data row with the closest other start that overlaps ``[start - reach, start +
    reach]``: ``q_id``, ``d_id``, ``distance``; ties go to the smaller id. Equal starts, so the row itself
    too, do not count. A query without a neighbour has no row.

    Starts within reach are looked up by fine bins of about the root of ``reach``: a query meets the different
    starts of its own bin, and only the first and the last start of the others, so however dense the data, some
    hundreds of starts. Only queries without any such start look for longer intervals that come from before.
    """
    fine = max(1, math.isqrt(reach))
    coarse = fine * -(-reach // fine)
    side = F.col("strand") if stranded else F.lit("")
    place = ["chr", "side", "at"]
    q = queries.select(F.col(q_id).alias("q_id"), "chr", side.alias("side"), F.col("start_pos").cast("bigint").alias("at")).filter("chr is not null and side is not null and at is not null")
    rows = data.filter("start_pos <= end_pos").select(F.col(d_id).alias("d_id"), "chr", side.alias("side"), F.col("start_pos").cast("bigint").alias("start"), F.col("end_pos").cast("bigint").alias("end"))
    bin_of = lambda at, width: F.floor(F.col(at) / width).cast("bigint")
    starts = rows.groupBy("chr", "side", "start").agg(F.min("d_id").alias("d_id")).withColumn("bin", bin_of("start", fine))
    own = q.withColumn("bin", bin_of("at", fine)).join(starts, ["chr", "side", "bin"])
    ends = starts.groupBy("chr", "side", "bin").agg(*[f(F.struct("start", "d_id")).alias(n) for f, n in ((F.min, "a"), (F.max, "b"))])
    ends = ends.select("chr", "side", "bin", F.explode(F.array("a", "b")).alias("x")).select("chr", "side", "bin", "x.*").withColumn("wide", bin_of("start", coarse))
    near = q.withColumn("own", bin_of("at", fine)).withColumn("wide", F.explode(F.sequence(bin_of("at", coarse) - 1, bin_of("at", coarse) + 1))).join(ends, ["chr", "side", "wide"]).filter("bin <> own")
    met = own.select("q_id", *place, "start", "d_id").unionByName(near.select("q_id", *place, "start", "d_id")).filter(f"start <> at and abs(start - at) < {reach}")
    closest = F.min(F.struct(F.abs(F.col("start") - F.col("at")).alias("distance"), "d_id")).alias("b")
    best = cut_lineage(met.groupBy("q_id").agg(closest))
    rest = q.join(best, "q_id", "left_anti").select("q_id", *place, (F.col("at") - reach).alias("start_pos"), (F.col("at") - reach + 1).alias("end_pos"))
    # equal intervals are one candidate, so a group of copies meets a query once
    long = rows.filter("start < end").groupBy("chr", "side", F.col("start").alias("start_pos"), F.col("end").alias("end_pos")).agg(F.min("d_id").alias("d_id"))
    before = overlap_join(rest, long).filter("q.side = d.side").select("q.q_id", "q.at", F.col("d.start_pos").alias("start"), "d.d_id")
    return best.unionByName(before.groupBy("q_id").agg(closest)).select("q_id", "b.d_id", "b.distance")


def sweep_active(arrivals: DataFrame, data: DataFrame, id_col: str) -> DataFrame:
    """Overlap sweep: for each arriving interval the number and the sorted ids of the intervals active
    with it, itself included, when more than one. Active are those that come no later in the order
    (start, end, id) and end at or after its start. Rows with a null or inverted interval are left out.
    """
    cols = [F.col(id_col).alias("id"), "chr", "start_pos", "end_pos"]
    pairs = overlap_join(arrivals.select(*cols), data.select(*cols), mode="touching")
    order = lambda s: F.struct(*[F.col(f"{s}.{c}") for c in ("start_pos", "end_pos", "id")])
    active = pairs.filter((order("d") <= order("q")) & (F.col("d.end_pos") >= F.col("q.start_pos")))
    return active.groupBy(F.col("q.id").alias("id")).agg(F.count(F.lit(1)).alias("n_active"), F.sort_array(F.collect_list("d.id")).alias("active")).filter("n_active > 1")


def bin_statistics(df: DataFrame, width: int, score: str = "score") -> DataFrame:
    """Intervals per fixed-width bin, every bin an interval meets counted: ``chr``, ``bin_start``,
    ``bin_end``, ``members``, ``low``, ``high``. Null and empty intervals meet no bin."""
    met = df.filter("chr is not null and start_pos < end_pos").withColumn("bin", F.explode(F.expr(f"sequence(cast(floor(start_pos / {width}) as bigint), cast(floor((end_pos - 1) / {width}) as bigint))")))
    return met.groupBy("chr", (F.col("bin") * width).alias("bin_start"), ((F.col("bin") + 1) * width).alias("bin_end")).agg(F.count(F.lit(1)).alias("members"), F.min(score).alias("low"), F.max(score).alias("high"))


def bin_members(df: DataFrame, width: int, id_col: str, chunk: int = 1000) -> DataFrame:
    """Members of each bin as sorted arrays. A bin with many members comes as several rows
    (``part``), so no group outgrows a task: about ``chunk`` members each, spread by a hash of the id."""
    met = df.filter("chr is not null and start_pos < end_pos").withColumn("bin", F.explode(F.expr(f"sequence(cast(floor(start_pos / {width}) as bigint), cast(floor((end_pos - 1) / {width}) as bigint))")))
    sizes = met.groupBy("chr", "bin").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts"))
    crowded = broadcast_if_small(sizes.filter("parts > 1"))
    spread = met.join(crowded, ["chr", "bin"], "left").withColumn("part", F.pmod(F.xxhash64(id_col), F.coalesce("parts", F.lit(1))))
    return spread.groupBy("chr", (F.col("bin") * width).alias("bin_start"), "part").agg(F.sort_array(F.collect_list(id_col)).alias("members"))


def _paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the winning order per tile; ``rows`` are the best (node, o, v) of each node of the tile's tree."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column(2)
        bounds, flat = rows.offsets.to_numpy(), rows.flatten()
        shift = int(bounds[0])
        node, order = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        value = flat.field(2).to_numpy(zero_copy_only=False).astype(np.float64).view(np.int64)
        depth = np.frexp(node.astype(np.float64))[1].astype(np.int64) - 1
        begin = (node - (1 << depth)) << (PAINT_BITS - depth)
        until = begin + (1 << (PAINT_BITS - depth))
        tiles = batch.column(1).to_numpy(zero_copy_only=False) << PAINT_BITS
        owner, starts, ends, picks = [], [], [], []
        for n, base in enumerate(tiles):
            own = np.arange(bounds[n] - shift, bounds[n + 1] - shift)
            own = own[np.argsort(order[own], kind="stable")]  # later ones win
            if len(own) <= FEW_NODES:
                edges = np.unique(np.concatenate((begin[own], until[own])))
                holds = (begin[own][None, :] <= edges[:-1, None]) & (edges[1:, None] <= until[own][None, :])
                pick = np.where(holds.any(1), own[len(own) - 1 - holds[:, ::-1].argmax(1)], -1)
            else:
                best = np.full(2 << PAINT_BITS, -1, dtype=np.int64)  # rank among the tile's nodes
                best[node[own]] = np.arange(len(own))
                for level in range(PAINT_BITS):
                    low = 1 << level
                    best[2 * low : 4 * low] = np.maximum(best[2 * low : 4 * low], np.repeat(best[low : 2 * low], 2))
                rank = best[1 << PAINT_BITS :]
                edges, pick = np.arange(len(rank) + 1), np.where(rank >= 0, own[rank], -1)
            same = (pick[1:] >= 0) & (pick[:-1] >= 0) & (order[pick[1:]] == order[pick[:-1]]) & (value[pick[1:]] == value[pick[:-1]])
            turn = np.flatnonzero(np.concatenate(([True], ~same)))
            close = edges[np.append(turn[1:], len(pick))]
            kept = pick[turn] >= 0
            owner.append(np.full(kept.sum(), n))
            starts.append(edges[turn][kept] + base)
            ends.append(close[kept] + base)
            picks.append(pick[turn][kept])
        at, pick = pa.array(np.concatenate(owner)), pa.array(np.concatenate(picks))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(starts)), pa.array(np.concatenate(ends)), flat.field(2).take(pick)], names=["chr", "tile", "s", "e", "v"]
        )


def dense_runs(df: DataFrame, order: str, score: str = "score") -> DataFrame:
    """Scores of all covered positions as runs, the last writer (greatest ``order``, a number) wins: ``chr``,
    ``tile``, ``start_pos``, ``end_pos``, ``score``.

    Intervals are cut into canonical blocks of the trees over tiles of 2**``PAINT_BITS`` positions. Of each block
    the last writer is kept, which is combined before the shuffle, so a tile gathers at most one state for each
    node of its tree, however many rows write to it; the winners are then handed down to the leaves. Rows with one
    order are interchangeable where they overlap: which of them wins is not defined. Null orders lose; null, empty
    and inverted intervals cover nothing.
    """
    usable = df.filter("chr is not null and start_pos < end_pos").select(
        "chr", F.col("start_pos").cast("bigint").alias("a"), F.col("end_pos").cast("bigint").alias("b"), F.coalesce(F.col(order).cast("bigint"), F.lit(-(2**63))).alias("o"), F.col(score).cast("double").alias("v")
    )
    cut = usable.withColumn("tile", F.explode(F.expr(f"sequence(shiftright(a, {PAINT_BITS}), shiftright(b - 1, {PAINT_BITS}))")))
    base = F.shiftleft("tile", PAINT_BITS)
    width = 1 << PAINT_BITS
    blocks = tree_blocks(cut.select("chr", "tile", "o", "v", F.greatest(F.lit(0), F.col("a") - base).alias("s"), F.least(F.lit(width), F.col("b") - base).alias("e")), F.col("s"), F.col("e"), 0, PAINT_BITS + 1)
    best = blocks.groupBy("chr", "tile", F.expr(f"cast(shiftleft(1L, {PAINT_BITS} - __level) + __index as int)").alias("node")).agg(F.max("o").alias("top"), F.max_by("v", "o").alias("v"))
    tiles = best.groupBy("chr", "tile").agg(F.collect_list(F.struct("node", F.col("top").alias("o"), "v")).alias("rows"))  # at most 2 ** (PAINT_BITS + 1) nodes
    return tiles.mapInArrow(_paint, "chr string, tile bigint, s bigint, e bigint, v double").select("chr", "tile", F.col("s").alias("start_pos"), F.col("e").alias("end_pos"), F.col("v").alias("score"))


def dense_scores(df: DataFrame, order: str, score: str = "score") -> DataFrame:
    """:func:`dense_runs` position by position: ``chr``, ``pos``, ``score``."""
    return dense_runs(df, order, score).select("chr", F.explode(F.expr("sequence(start_pos, end_pos - 1)")).alias("pos"), "score")


def score_at(loci: DataFrame, runs: DataFrame) -> DataFrame:
    """``loci`` (chr, pos, ...) with ``score`` from :func:`dense_runs`, 0 where nothing was written. Runs are looked up by
    bins of 2**``LOOKUP_BITS`` positions, so a locus is compared with that many runs at most."""
    r = runs.withColumn("__t", F.explode(F.expr(f"sequence(shiftright(start_pos, {LOOKUP_BITS}), shiftright(end_pos - 1, {LOOKUP_BITS}))")))
    r = r.select(F.col("chr").alias("__c"), "__t", F.col("start_pos").alias("__s"), F.col("end_pos").alias("__e"), F.col("score").alias("__v"))
    at = F.expr(f"shiftright(cast(pos as bigint), {LOOKUP_BITS})")
    joined = loci.join(r, (F.col("chr") == F.col("__c")) & (at == F.col("__t")) & (F.col("__s") <= F.col("pos")) & (F.col("pos") < F.col("__e")), "left")
    return joined.withColumn("score", F.coalesce("__v", F.lit(0.0))).drop("__c", "__t", "__s", "__e", "__v")


def concat_offsets(sizes: DataFrame, order: str, length: str, chunk: int = 1 << 16) -> DataFrame:
    """``sizes`` with ``offset``: the exclusive running total of ``length`` in the order of ``order``.

    Ranges of sorted rows are added up first; only their totals go through one window. The ranges are
    written once, as sampling them again could cut them elsewhere. ``order`` should be unique.
    """
    spark = sizes.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut_lineage(sizes.repartitionByRange(parts, F.col(order)).withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy("__part").agg(F.sum(length).alias("__sum"))  # one row a partition
    before = totals.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    inside = F.coalesce(F.sum(length).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(broadcast_if_small(before, chunk), "__part").withColumn("offset", inside + F.col("__before")).drop("__part", "__before")


def to_text_index(loci: DataFrame, offsets: DataFrame) -> DataFrame:
    """chr and 1-based pos to a 0-based index of the joined text; -1 for an unknown chr."""
    o = broadcast_if_small(offsets.select(F.col("chr").alias("__c"), F.col("offset").alias("__o")))
    return loci.join(o, F.col("chr") == F.col("__c"), "left").withColumn("text_index", F.coalesce(F.col("__o") + F.col("pos") - 1, F.lit(-1))).drop("__c", "__o")


def to_locus(indexes: DataFrame, offsets: DataFrame, length: str = "n_bases", bin_bits: int = 20) -> DataFrame:
    """1-based text index to chr and pos (as-of join on the offset); indexes beyond the text drop out."""
    o = offsets.select("chr", "offset", F.col(length).alias("__n")).filter("__n > 0")
    o = o.withColumn("__bin", F.explode(F.expr(f"sequence(shiftright(offset + 1, {bin_bits}), shiftright(offset + __n, {bin_bits}))")))
    i = indexes.withColumn("__bin", F.expr(f"shiftright(text_index, {bin_bits})"))
    return i.join(o, "__bin").filter("offset < text_index and text_index <= offset + __n").withColumn("pos", F.col("text_index") - F.col("offset")).drop("__bin", "__n", "offset")


def natural_order(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``rank_key``, a text that sorts names naturally: digit runs by value, digits first.

    Each digit run is written as the count of its digits and the run itself, so chr2 comes before chr10;
    no driver pass is needed.
    """
    widths = F.aggregate(
        F.regexp_extract_all(F.col(name), F.lit(r"(\d+|\D+)"), F.lit(0)), F.lit(""),
        lambda acc, x: F.concat(acc, F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(F.regexp_replace(x, r"^0+(?=\d)", "")).cast("string"), 3, "0"), F.regexp_replace(x, r"^0+(?=\d)", ""))).otherwise(x)),
    )
    return df.withColumn("rank_key", widths)


def zip_by_order(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Rows of two tables paired by their place in an order, as structs ``a`` and ``b`` with ``ordinal``; ends
    with the shorter one."""
    number = lambda df, order, name: concat_offsets(df.select(F.col(order).alias("__o"), F.struct("*").alias(name), F.lit(1).alias("__one")), "__o", "__one").select(F.col("offset").alias("ordinal"), name)
    return number(left, left_order, "a").join(number(right, right_order, "b"), "ordinal")


def top_hits(hits: DataFrame, read: str, score: Column, limit: int | None = 5) -> DataFrame:
    """The ``limit`` best hits of each read (all for None) with ``hit_rank``; ties by chr, pos, strand."""
    ranked = hits.withColumn("hit_rank", F.row_number().over(Window.partitionBy(read).orderBy(score.desc(), "chr", "start_pos", "strand")))
    return ranked if limit is None else ranked.filter(F.col("hit_rank") <= limit)
