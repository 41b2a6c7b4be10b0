"""Spans of at least ``SPAN`` letters that stand verbatim in records of different names.

MinHash banding with the paragraph taken as every window of ``SPAN`` letters: its shingles are the 25-mers
in it and its sketch is the least shingle hash. Equal windows have Jaccard similarity 1, so one band of one
row has a recall of exactly 1. Neighbouring windows with one sketch form a segment. A first pass adds up the
least name, the greatest name and the segments of every sketch, combined before the shuffle; sketches under
one name only cannot be shared. A second pass takes the segments of the others, and only these move, to the
task of their sketch, where windows are compared letter by letter (two 50-bit numbers, no hash). The sketches
that more than ``hot`` segments have are compared window by window over all tasks instead. Both ways keep
the least and the greatest name of a window: no pair of records is ever formed.

Where this leaves the common form of the method: several rows to a band would lose equal windows of unequal
paragraphs, so there is one; and as only equal windows count, the check is for equality, not for a Jaccard
threshold or an edit distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.llm.components import components
from lociframe.operators.dyadic import coalesced
from lociframe.session import broadcast_if_small, cut_lineage

SPAN = 50
SHINGLE = 25
SLICE = 1 << 18
HOT = 1 << 16
TILE_BITS = 15
SEEDS = 8

_SPACES = re.compile(r"[ \t\n\x0b\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_GONE = 5
_CODE = np.full(256, 4, dtype=np.uint8)
_CODE[[ord(c) for c in "ACGTacgt"]] = [0, 1, 2, 3] * 2
_CODE[[ord(c) for c in " \t\n\x0b\f\r"]] = _GONE


def _shingles(code: np.ndarray) -> np.ndarray:
    """2-bit numbers of all 25-mers of a slice."""
    one = (code & 3).astype(np.int64)
    two = (one[:-1] << 2) | one[1:]
    four = (two[:-2] << 4) | two[2:]
    eight = (four[:-4] << 8) | four[4:]
    most = (eight[:-8] << 16) | eight[8:]
    most = (most[:-8] << 16) | eight[16 : 16 + len(most) - 8]
    return (most[: len(one) - 24] << 2) | one[24:]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segments_of(code: np.ndarray, record: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of one slice of joined letters (as codes): record, place, windows, sketch and three 25-mers."""
    n = len(code) - SPAN + 1
    if n <= 0:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(7))
    bad = np.concatenate(([0], np.cumsum(code == 4)))
    valid = (bad[SPAN:] == bad[:n]) & (record[:n] == record[SPAN - 1 :])
    mers = _shingles(code)
    least = _mixed(mers)
    for width in (1, 2, 4, 8):
        least = np.minimum(least[:-width], least[width:])
    least = np.minimum(least[:n], least[10 : n + 10])  # 26 shingles
    opens = valid.copy()
    opens[1:] &= ~(valid[:-1] & (record[1:n] == record[: n - 1]) & (least[1:] == least[:-1]))
    at = np.flatnonzero(opens)
    if not len(at):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(7))
    ends = np.flatnonzero(valid & ~np.concatenate((valid[1:] & ~opens[1:], [False]))) + 1
    length = ends - at
    pieces = -(-length // SHINGLE)  # a repeated shingle can make a segment long: at most 25 windows each
    first = np.repeat(at, pieces) + SHINGLE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    length = np.minimum(np.repeat(ends, pieces) - first, SHINGLE)
    return record[first], place[first], length, least[first].view(np.int64), mers[first], mers[first + SHINGLE], mers[first + SHINGLE + length - 1]


def letter_codes(seq: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all letters without white space, and the offsets of the rows; a null row has no letter."""
    seq = seq.cast(pa.large_string())  # 64-bit offsets, whatever the session sends
    offsets = np.frombuffer(seq.buffers()[1], dtype=np.int64)[seq.offset : seq.offset + len(seq) + 1]
    letters = np.frombuffer(seq.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if len(letters) and letters.max() >= 128:  # one code for each character
        texts = [_SPACES.sub("", t or "").encode("ascii", "replace") for t in seq.to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        letters = np.frombuffer(b"".join(texts), dtype=np.uint8)
    code = _CODE[letters]
    kept = code != _GONE
    if not kept.all():
        offsets = np.concatenate(([0], np.cumsum(kept)))[offsets]
        code = code[kept]
    return code, offsets


def _slices(seq: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    code, offsets = letter_codes(seq)
    for at in range(0, len(code), SLICE):
        stop = min(len(code), at + SLICE + SPAN - 1)
        inside = np.arange(at, stop, dtype=np.int64)
        record = np.searchsorted(offsets, inside, side="right") - 1
        found = segments_of(code[at:stop], record, inside - offsets[record])
        if len(found[0]):
            yield found


def _sketch_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name_key, letters) to the sketches of each batch: least name, greatest name, segments."""
    for batch in batches:
        name = batch.column(0).to_numpy(zero_copy_only=False)
        found = [(s[3], name[s[0]]) for s in _slices(batch.column(1))]
        if not found:
            continue
        sketch, name = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(sketch, kind="stable")
        sketch, name = sketch[order], name[order]
        at = np.flatnonzero(np.concatenate(([True], sketch[1:] != sketch[:-1])))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (sketch[at], np.minimum.reduceat(name, at), np.maximum.reduceat(name, at), np.diff(np.append(at, len(sketch))))], names=["sketch", "lo", "hi", "n"]
        )


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for found in _slices(batch.column(3)):
            rows = pa.array(found[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(rows) for i in range(3)] + [pa.array(found[1].astype(np.int32)), pa.array(found[2].astype(np.int32)), *map(pa.array, found[3:])],
                names=["rec_table", "rec_id", "name_key", "place", "windows", "sketch", "mer_a", "mer_b", "mer_c"],
            )


def _windows_of(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Windows of segments: number of the segment, number within it, and the letters as two 50-bit numbers."""
    count, a, b, c = (part.column(i).to_numpy(zero_copy_only=False).astype(np.uint64) for i in (4, 6, 7, 8))
    size = count.astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    i = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    two = np.uint64(2) * i.astype(np.uint64)
    low = np.uint64((1 << 50) - 1)
    head = ((a[owner] << two) & low) | (b[owner] >> (np.uint64(50) - two))
    rest = np.uint64(2) * (count[owner] - np.uint64(1)) - two
    tail = ((b[owner] << two) & low) | ((c[owner] >> rest) & ((np.uint64(1) << two) - np.uint64(1)))
    return owner, i, head, tail


def _shared_in(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The windows of whole sketches that stand under several names: segment, number within it, name, least name and
    a key of the set of names."""
    owner, i, head, tail = _windows_of(part)
    name = part.column(2).to_numpy(zero_copy_only=False)[owner]
    key = _mixed(head) ^ (_mixed(tail ^ np.uint64(0x9E3779B97F4A7C15)) << np.uint64(1))
    order = np.argsort(key, kind="stable")
    differs = lambda x: x[order][1:] != x[order][:-1]
    if (~differs(key) & (differs(head) | differs(tail))).any():  # two windows with one key
        order = np.lexsort((tail, head))
    at = np.flatnonzero(np.concatenate(([True], differs(head) | differs(tail))))
    size = np.diff(np.append(at, len(order)))
    name = name[order]
    lo, hi = np.minimum.reduceat(name, at), np.maximum.reduceat(name, at)
    keep = np.repeat(lo != hi, size)
    return owner[order][keep], i[order][keep], name[keep], np.repeat(lo, size)[keep], np.repeat(np.arange(len(at)), size)[keep]


def _by_sketch(found):
    """Arrow mapper over segments sorted by sketch, applying ``found`` to whole sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            rows += batch.num_rows
            if rows < HOT:
                continue
            table = pa.Table.from_batches(kept).combine_chunks()
            sketch = table.column(5).to_numpy()
            cut = int(np.searchsorted(sketch, sketch[-1], side="left"))  # the last sketch may go on
            if cut:
                yield from found(table.slice(0, cut).combine_chunks().to_batches()[0])
                table = table.slice(cut)
            kept, rows = table.combine_chunks().to_batches(), table.num_rows
        if rows:
            yield from found(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])

    return run


def _runs(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    owner, i, *_ = _shared_in(part)
    if not len(owner):
        return
    order = np.lexsort((i, owner))
    owner, i = owner[order], i[order]
    at = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (i[1:] != i[:-1] + 1))))
    last = np.append(at[1:], len(owner)) - 1
    rows = pa.array(owner[at])
    place = part.column(3).to_numpy(zero_copy_only=False)
    yield pa.RecordBatch.from_arrays(
        [part.column(0).take(rows), part.column(1).take(rows), pa.array((place[owner[at]] + i[at]).astype(np.int32)), pa.array((place[owner[last]] + i[last] + SPAN).astype(np.int32))],
        names=["rec_table", "rec_id", "span_start", "span_end"],
    )


def _sets(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Each distinct set of names once for each of its names: ``names`` (a key of the set), ``name_key``, ``least``."""
    _, _, name, least, group = _shared_in(part)
    if not len(name):
        return
    order = np.lexsort((name, group))
    name, least, group = name[order], least[order], group[order]
    once = np.concatenate(([True], (group[1:] != group[:-1]) | (name[1:] != name[:-1])))
    name, least, group = name[once], least[once], group[once]
    at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    key = np.repeat(np.add.reduceat(_mixed(name.view(np.uint64)), at), np.diff(np.append(at, len(group)))).view(np.int64)
    rows = np.unique(np.stack((key, name, least), axis=1), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=["names", "name_key", "least"])


def records(df: DataFrame, rec_table: str, id_col: str, name: str = "name", seq: str = "seq") -> DataFrame:
    """Records in the form that the operator reads. A null name is a name of its own for each row."""
    own = F.concat(F.lit("row "), F.lit(rec_table), F.lit(" "), F.col(id_col).cast("string"))
    return df.select(
        F.lit(rec_table).alias("rec_table"),
        F.col(id_col).cast("bigint").alias("rec_id"),
        F.when(F.col(name).isNull(), own).otherwise(F.concat(F.lit("name "), F.col(name))).alias("label"),
        F.col(seq).alias("letters"),
    )


def keyed(recs: DataFrame) -> DataFrame:
    """``recs`` with ``name_key``, a 64-bit hash of the name by the first seed under which no two names share one."""
    for seed in range(SEEDS):
        key = F.xxhash64(F.lit(seed), "label")
        met = recs.groupBy(key.alias("k"), "label").count().groupBy("k").count().filter("count > 1")
        if not met.limit(1).count():
            return recs.select("rec_table", "rec_id", key.alias("name_key"), "letters")
    raise RuntimeError(f"names share hashes under {SEEDS} seeds")


def _joined_by_count(rows: DataFrame, kept: DataFrame, keys: list[str], spread: Column, hot: int) -> DataFrame:
    """Inner join of ``rows`` with one row a key (``n``: its rows); the rows of a key with more than ``hot`` are spread
    over as many parts as that takes."""
    parts = kept.withColumn("__parts", F.ceil(F.col("n") / hot).cast("int")).drop("n")
    crowded = broadcast_if_small(parts.filter("__parts > 1").select(*keys, F.col("__parts").alias("__p")))
    salted = parts.withColumn("__salt", F.explode(F.expr("sequence(0, __parts - 1)"))).drop("__parts")
    placed = rows.join(crowded, keys, "left").withColumn("__salt", F.pmod(spread, F.coalesce("__p", F.lit(1))).cast("int")).drop("__p")
    return placed.join(salted, [*keys, "__salt"]).drop("__salt")


_SEGMENT = "rec_table string, rec_id bigint, name_key bigint, place int, windows int, sketch bigint, mer_a bigint, mer_b bigint, mer_c bigint"


def _colliding(recs: DataFrame, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """Segments whose sketch stands under several names, those of a sketch in one partition and in a row; and
    those of hot sketches, None without any."""
    sketches = recs.select("name_key", "letters").mapInArrow(_sketch_names, "sketch bigint, lo bigint, hi bigint, n bigint")
    shared = cut_lineage(sketches.groupBy("sketch").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).filter("lo <> hi").select("sketch", "n"))
    segments = recs.select("rec_table", "rec_id", "name_key", "letters").mapInArrow(_segments, _SEGMENT)
    cold = segments.join(broadcast_if_small(shared.filter(F.col("n") <= hot).select("sketch"), 1_000_000, 64 << 20), "sketch", "left_semi")
    cold = cold.select("rec_table", "rec_id", "name_key", "place", "windows", "sketch", "mer_a", "mer_b", "mer_c").repartition("sketch").sortWithinPartitions("sketch")
    crowded = shared.filter(F.col("n") > hot)
    if not crowded.limit(1).count():
        return cold, None
    return cold, _joined_by_count(segments, crowded, ["sketch"], F.xxhash64("rec_id", "place"), hot)


def _hot_windows(segments: DataFrame, hot: int) -> DataFrame:
    """Windows of ``segments`` that stand under several names, with ``least``, the least of them."""
    low = (1 << 50) - 1
    windows = segments.withColumn("i", F.explode(F.expr("sequence(0, windows - 1)"))).select(
        "rec_table", "rec_id", "name_key", (F.col("place") + F.col("i")).alias("place"),
        F.expr(f"(shiftleft(mer_a, 2 * i) & {low}L) | shiftright(mer_b, 50 - 2 * i)").alias("head"),
        F.expr(f"(shiftleft(mer_b, 2 * i) & {low}L) | (shiftright(mer_c, 2 * (windows - 1 - i)) & (shiftleft(1L, 2 * i) - 1))").alias("tail"),
    )
    kept = cut_lineage(windows.groupBy("head", "tail").agg(F.min("name_key").alias("least"), F.max("name_key").alias("hi"), F.count(F.lit(1)).alias("n")).filter("least <> hi").drop("hi"))
    return _joined_by_count(windows, kept, ["head", "tail"], F.xxhash64("rec_id", "place"), hot)


def shared_spans(recs: DataFrame, hot: int = HOT) -> DataFrame:
    """Longest runs of shared positions: ``rec_table``, ``rec_id``, ``span_start``, ``span_end``.

    ``recs`` comes from :func:`records`, possibly a union of several. A position is shared if it lies in
    a window of ``SPAN`` letters A, C, G, T that also stands in a record of another name (same strand, white
    space left out, case ignored). Null, empty and shorter sequences share nothing; rows of one name share
    nothing with each other, but each gets its own runs. An id should be unique in its table: rows repeating
    one are reported together.
    """
    cold, crowded = _colliding(keyed(recs), hot)
    runs = cold.mapInArrow(_by_sketch(_runs), "rec_table string, rec_id bigint, span_start int, span_end int")
    if crowded is not None:
        runs = runs.unionByName(_hot_windows(crowded, hot).select("rec_table", "rec_id", F.col("place").alias("span_start"), (F.col("place") + SPAN).alias("span_end")))
    tile = lambda at: F.expr(f"shiftright({at}, {TILE_BITS})")
    edge = F.shiftleft(tile("span_start") + 1, TILE_BITS)
    halves = F.array(
        F.struct(tile("span_start").alias("tile"), F.col("span_start"), F.least("span_end", edge).alias("span_end")),
        F.when(F.col("span_end") > edge, F.struct((tile("span_start") + 1).alias("tile"), edge.alias("span_start"), F.col("span_end"))),
    )
    pieces = runs.select("rec_table", "rec_id", F.explode(halves).alias("x")).filter("x is not null").select("rec_table", "rec_id", "x.*")
    return coalesced(pieces, ["rec_table", "rec_id"], "tile", "span_start", "span_end")


def shared_clusters(recs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per record: ``cluster``, the same for all records that are linked by shared windows, directly or over
    others, and ``links``, with how many other names it shares a window.

    Windows with one set of names count once. Every set links its names with the least of them, which keeps
    all connections without pairs. The sets a name is in are united as HyperLogLog sketches of 2**12 registers, so
    ``links`` is off by about 2 % where it is large. Records that share nothing are a cluster of their own.
    """
    recs = keyed(recs)
    cold, crowded = _colliding(recs, hot)
    sets = cold.mapInArrow(_by_sketch(_sets), "names bigint, name_key bigint, least bigint")
    if crowded is not None:
        sets = sets.unionByName(_hot_windows(crowded, hot).select(F.xxhash64("head", "tail").alias("names"), "name_key", "least"))
    sets = cut_lineage(sets.distinct())
    found = components(sets.select(F.col("name_key").alias("u"), F.col("least").alias("v")).distinct())
    united = sets.groupBy("names").agg(F.hll_sketch_agg("name_key", 12).alias("sketch"), F.count(F.lit(1)).alias("n"))
    links = _joined_by_count(sets.select("names", "name_key"), united, ["names"], F.xxhash64("name_key"), hot).groupBy("name_key").agg((F.hll_sketch_estimate(F.hll_union_agg("sketch")) - 1).alias("links"))
    out = recs.select("rec_table", "rec_id", "name_key").join(found, F.col("name_key") == F.col("node"), "left").join(links, "name_key", "left")
    return out.select("rec_table", "rec_id", F.coalesce("component", "name_key").alias("cluster"), F.coalesce("links", F.lit(0)).alias("links"))


def shared_shares(recs: DataFrame, spans: DataFrame) -> DataFrame:
    """Per record: ``letters``, ``shared_letters`` and ``share`` (null for an empty sequence)."""
    per = spans.groupBy("rec_table", "rec_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_letters"), F.count(F.lit(1)).alias("n_spans"))
    shared: Column = F.coalesce("shared_letters", F.lit(0))
    letters = F.coalesce(F.length(F.regexp_replace("letters", r"[\s\p{Z}]+", "")), F.lit(0))
    return recs.select("rec_table", "rec_id", letters.alias("letters")).join(per, ["rec_table", "rec_id"], "left").select(
        "rec_table", "rec_id", "letters", shared.alias("shared_letters"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.try_divide(shared, "letters").alias("share")
    )
