"""Suffix array, BWT, occurrence table and backward search.

The suffix array of a large text is built by prefix doubling on a DataFrame: ranks of the first k letters
are paired with the ranks k places on and ranked again, so each round is a join on the position and a
ranking. It starts from as many letters as a number holds, about 20 of a sequence, and a suffix whose rank is its
own leaves the rounds. Ranking goes by ranges: rows are range-partitioned by their key, and
only the group counts of the ranges go through a window. Texts are cyclic: rotations are compared, so a
text that is a repetition of a part has ties, which are broken by position.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociframe.operators.overlap import concat_offsets
from lociframe.session import cut_lineage, is_small


TOGETHER = 1 << 20
LETTER_TILE = 1 << 14
BLOCK_RANGE = 4096


def cyclic_suffix_array(text: list[int] | np.ndarray) -> np.ndarray:
    """Positions of the sorted rotations of one text that fits into a task (prefix doubling)."""
    rank = np.unique(np.asarray(text, dtype=np.int64), return_inverse=True)[1].astype(np.int64)
    n, k = len(rank), 1
    while k < n and (n and rank.max() < n - 1):
        rank = np.unique(rank * (n + 1) + np.roll(rank, -k), return_inverse=True)[1].astype(np.int64)
        k *= 2
    return np.lexsort((np.arange(n), rank))


def _rotations(codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sorted rotations of many texts at once: places in the joined text, text by text. Equal rotations of a text go by
    position."""
    n = len(codes)
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(n) - first[owner]
    rank = np.unique(owner * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
    k = 1
    while k < size.max() and rank.max() < n - 1:
        rank = np.unique(rank * (n + 1) + rank[first[owner] + (at + k) % size[owner]], return_inverse=True)[1]
        k *= 2
    return np.argsort(rank, kind="stable")


def suffix_arrays(df: DataFrame, id_col: str, text: str, sentinel: bool = True) -> DataFrame:
    """Suffix arrays of many short texts, each within a task: id, ``i``, ``pos``, ``bwt``.

    With ``sentinel`` a ``$`` smaller than every letter closes each text. ``bwt`` is the letter before ``pos``.
    Null texts, and empty ones without sentinel, have no row. Texts are sorted together, about ``TOGETHER``
    letters at a time.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t + "$" if sentinel else t for t in batch.column(1).to_pylist()]
            low = 0
            while low < len(texts):
                high, letters = low, 0
                while high < len(texts) and letters < TOGETHER:
                    letters, high = letters + len(texts[high]), high + 1
                if letters:
                    size = np.array([len(t) for t in texts[low:high]])
                    letter = np.frombuffer("".join(texts[low:high]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
                    order = _rotations(np.where(letter == ord("$"), 0, letter), size)
                    owner = np.repeat(np.arange(len(size)), size)  # texts keep their places in the order
                    first = (np.cumsum(size) - size)[owner]
                    pos = order - first
                    before = letter[first + (pos - 1) % size[owner]]
                    symbols, which = np.unique(before, return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(owner + low)), pa.array(np.arange(len(order)) - first), pa.array(pos), pa.array([chr(c) for c in symbols]).take(pa.array(which))], names=["id", "i", "pos", "bwt"]
                    )
                low = high

    made = df.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInArrow(build, f"id {kind}, i bigint, pos bigint, bwt string")
    return made.withColumnRenamed("id", id_col)


def _dense_rank(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """``keys``, ``rank`` (how many rows have smaller keys) and ``n`` (how many have these) of all distinct keys. Range
    partitions first, one row per partition after."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    ranged = cut_lineage(counts.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()))  # the partition numbers must be the same for both uses
    totals = ranged.groupBy("__part").agg(F.sum("n").alias("__sum"))
    base = totals.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(base), "__part").select(*keys, (inside + F.col("__base")).alias("rank"), "n")  # ``parts`` rows


def _first_letters(letters: DataFrame, length: int) -> tuple[DataFrame, int]:
    """``pos`` and ``head``, a number that orders the first letters from there on, and how many letters it holds. Letters
    meet in tiles of the text, with those that follow the tile."""
    symbols = sorted(r[0] for r in letters.select("letter").distinct().collect())  # the alphabet
    bits = max(1, len(symbols).bit_length())
    held = min(63 // bits, length)
    tiles = -(-length // LETTER_TILE)
    code = F.coalesce(*[F.when(F.col("letter") == c, k) for k, c in enumerate(symbols)]) if symbols else F.lit(0)
    home = F.expr(f"cast(pos div {LETTER_TILE} as int)")
    # a letter also belongs to each tile that it follows within ``held`` letters, cyclically
    follows = F.when(F.col("pos") % LETTER_TILE < held, F.pmod(home - 1, F.lit(tiles)).cast("int"))
    short = length % LETTER_TILE
    further = F.when(F.lit(0 < short < held and tiles > 1) & (F.col("pos") < held - short), F.lit(max(0, tiles - 2)))
    placed = letters.select("pos", code.alias("c"), F.explode(F.array_distinct(F.filter(F.array(home, follows, further), lambda t: t.isNotNull()))).alias("tile"))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1)
            bounds, flat = rows.offsets.to_numpy(), rows.flatten()
            pos, c = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            for n, tile in enumerate(batch.column(0).to_pylist()):
                own = slice(bounds[n] - bounds[0], bounds[n + 1] - bounds[0])
                low = tile * LETTER_TILE
                size = min(LETTER_TILE, length - low)
                line = np.zeros(size + held, dtype=np.int64)
                for turn in range(-(-held // length) + 1):  # the text goes on from its start
                    at = pos[own] - low + turn * length
                    inside = (at >= 0) & (at < len(line))
                    line[at[inside]] = c[own][inside]
                head = np.zeros(size, dtype=np.int64)
                for k in range(held):
                    head = (head << bits) | line[k : k + size]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + size)), pa.array(head)], names=["pos", "head"])

    tiled = placed.groupBy("tile").agg(F.collect_list(F.struct("pos", "c")).alias("rows"))  # at most a tile and what follows
    return tiled.mapInArrow(heads, "pos bigint, head bigint"), held


def distributed_suffix_array(letters: DataFrame, length: int, parts: int | None = None) -> DataFrame:
    """Suffix array of one long text from its rows (``pos``, ``letter``): ``i``, ``pos``.

    ``length`` is the number of letters; positions run from 0. Suffixes are ranked by as many letters as a number
    holds, then by twice as many in each round, and only those that still share a rank go on. Lineage is cut in
    every round. Sides with a row a letter are joined by shuffles: Spark takes the letters of a compressed file for small
    and would send them through the driver.
    """
    parts = parts or letters.sparkSession.sparkContext.defaultParallelism
    heads, k = _first_letters(letters, length)
    heads = cut_lineage(heads)
    ranked = cut_lineage(heads.join(_dense_rank(heads, ["head"], parts).hint("merge"), "head").select("pos", "rank", "n"))
    done, open_ = ranked.filter("n = 1").select("pos", "rank"), ranked.filter("n > 1").select("pos", "rank")
    while k < length and open_.limit(1).count():
        ahead = done.unionByName(open_).select(F.pmod(F.col("pos") - k, F.lit(length)).alias("pos"), F.col("rank").alias("then"))
        few = F.broadcast(open_) if is_small(open_) else open_.hint("merge")
        pairs = cut_lineage(few.join(ahead, "pos").select("pos", F.col("rank").alias("first"), "then"))
        among = _dense_rank(pairs, ["first", "then"], parts)  # counted among the open ones
        start = among.groupBy("first").agg(F.min("rank").alias("start"))
        new = among.join(start.hint("merge"), "first").select("first", "then", (F.col("first") + F.col("rank") - F.col("start")).alias("rank"), "n")
        ranked = cut_lineage(pairs.join(new.hint("merge"), ["first", "then"]).select("pos", "rank", "n"))
        done = done.unionByName(ranked.filter("n = 1").select("pos", "rank"))
        open_ = ranked.filter("n > 1").select("pos", "rank")
        k *= 2
    tie = F.row_number().over(Window.partitionBy("rank").orderBy("pos")) - 1  # left where rotations are equal
    return done.select(F.col("rank").alias("i"), "pos").unionByName(open_.select((F.col("rank") + tie).alias("i"), "pos"))


def burrows_wheeler(sa: DataFrame, letters: DataFrame, length: int) -> DataFrame:
    """``i`` and ``letter``: the letter before each suffix, cyclically."""
    before = letters.select(((F.col("pos") + 1) % length).alias("pos"), "letter")
    return sa.join(before.hint("merge"), "pos").select("i", "letter")


def smaller_counts(letters: DataFrame) -> DataFrame:
    """C: per letter, how many letters of the text are smaller, and how many are equal."""
    counts = letters.groupBy("letter").agg(F.count(F.lit(1)).alias("n"))  # one row per symbol
    return counts.select("letter", "n", F.coalesce(F.sum("n").over(Window.orderBy("letter").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("smaller"))


def occurrence_table(bwt: DataFrame, step: int) -> DataFrame:
    """Occurrences of each letter before every ``step``-th row: ``block``, ``letter``, ``n`` (in the block) and ``occ``, for
    every letter of the text and every block.

    Counts per block come first, in one pass over the rows; the running sum is over blocks within ranges of ``BLOCK_RANGE``,
    and over ranges.
    """
    counts = cut_lineage(bwt.groupBy(F.expr(f"i div {step}").alias("block"), "letter").agg(F.count(F.lit(1)).alias("n")))
    symbols = sorted(r[0] for r in counts.select("letter").distinct().collect())  # the alphabet
    per = counts.groupBy("block").agg(*[F.sum(F.when(F.col("letter") == c, F.col("n")).otherwise(0)).alias(f"n{k}") for k, c in enumerate(symbols)])
    per = per.withColumn("__range", F.expr(f"block div {BLOCK_RANGE}"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    near = before(Window.partitionBy("__range").orderBy("block"))
    far = before(Window.orderBy("__range"))  # one row a range
    within = per.select("*", *[F.coalesce(F.sum(f"n{k}").over(near), F.lit(0)).alias(f"a{k}") for k in range(len(symbols))])
    sums = per.groupBy("__range").agg(*[F.sum(f"n{k}").alias(f"s{k}") for k in range(len(symbols))])
    bases = sums.select("__range", *[F.coalesce(F.sum(f"s{k}").over(far), F.lit(0)).alias(f"b{k}") for k in range(len(symbols))])
    rows = F.array(*[F.struct(F.lit(c).alias("letter"), F.col(f"n{k}").alias("n"), (F.col(f"a{k}") + F.col(f"b{k}")).alias("occ")) for k, c in enumerate(symbols)])
    return within.join(bases.hint("merge"), "__range").select("block", F.explode(rows).alias("x")).select("block", "x.*")


def joined_letters(sequences: DataFrame, order: str, seq: str, even: bool = False, backwards: bool = False) -> tuple[DataFrame, int]:
    """All sequences as one text, in the order of ``order``: rows (``pos``, ``letter``, a code point), and its length.

    A sentinel, 0, closes the text. With ``even`` an N is put before it where the length would be odd. ``backwards`` turns
    the text around, the sentinel staying last. Null sequences have no letter.
    """
    text = concat_offsets(sequences.select(order, F.coalesce(F.col(seq), F.lit("")).alias("s")).withColumn("n", F.length("s")), order, "n")
    letters = text.select("offset", F.posexplode(F.filter(F.split("s", ""), lambda x: x != "")).alias("p", "c")).select((F.col("offset") + F.col("p")).cast("bigint").alias("pos"), F.ascii("c").alias("letter"))
    n = int(text.agg(F.sum("n")).first()[0] or 0)
    more = [ord("N")] if even and n % 2 == 0 else []
    size = n + len(more)
    letters = letters.unionByName(sequences.sparkSession.createDataFrame([(n + k, c) for k, c in enumerate(more)], "pos bigint, letter int"))
    if backwards:
        letters = letters.withColumn("pos", F.lit(size - 1).cast("bigint") - F.col("pos"))
    return letters.unionByName(sequences.sparkSession.createDataFrame([(size, 0)], "pos bigint, letter int")), size + 1


def write_index_set(path: str, sequences: DataFrame, name: str, order: str, seq: str, step: int = 128, sample: int = 32) -> None:
    """Indexes of the joined text and of the reversed one, ``forward`` and ``reverse`` below ``path``, and ``sequences``: name,
    length and offset of each. See :func:`write_index`."""
    sized = sequences.select(order, F.col(name).alias("name"), F.coalesce(F.length(seq), F.lit(0)).alias("length"))
    concat_offsets(sized, order, "length").write.mode("errorifexists").parquet(f"{path}/sequences")
    for folder, backwards in (("forward", False), ("reverse", True)):
        letters, n = joined_letters(sequences, order, seq, even=True, backwards=backwards)
        write_index(f"{path}/{folder}", letters, n, step, sample)


def write_index(path: str, letters: DataFrame, length: int, step: int = 128, sample: int = 32) -> None:
    """The index of a text as Parquet below ``path``: ``bwt`` (letter of each row), ``occurrences`` before every ``step``-th
    row, ``smaller`` counts, and ``places``, the suffix array at every ``sample``-th row. Index the reversed text into a
    second folder to search both ways."""
    sa = cut_lineage(distributed_suffix_array(letters, length))
    bwt = cut_lineage(burrows_wheeler(sa, letters, length))
    for name, part in {"bwt": bwt, "occurrences": occurrence_table(bwt, step), "smaller": smaller_counts(letters), "places": sa.filter(F.col("i") % sample == 0)}.items():
        part.write.mode("errorifexists").parquet(f"{path}/{name}")


class FMIndex:
    """Index of one text in a task: exact search by backward steps. Of the suffix array only every ``sample``-th place
    of the text is kept; others are found by steps from last to first."""

    def __init__(self, text: str, sentinel: bool = True, sample: int = 32):
        self.text = text + "$" if sentinel else text
        codes = np.array([0 if c == "$" else ord(c) for c in self.text], dtype=np.int64)
        sa = cyclic_suffix_array(codes)
        self.bwt = codes[sa - 1]
        self.places = {i: p for i, p in enumerate(sa.tolist()) if p % sample == 0}
        self.alphabet = sorted(set(codes.tolist()))
        self.occ = {c: np.concatenate(([0], np.cumsum(self.bwt == c))) for c in self.alphabet}
        self.smaller = {c: int((codes < c).sum()) for c in self.alphabet}

    def step(self, letter: str, lo: int, hi: int) -> tuple[int, int]:
        """The suffix interval after one more letter in front; empty if lo >= hi."""
        c = ord(letter)
        if c not in self.occ:
            return 0, 0
        return self.smaller[c] + int(self.occ[c][lo]), self.smaller[c] + int(self.occ[c][hi])

    def last_to_first(self, i: int) -> int:
        c = int(self.bwt[i])
        return self.smaller[c] + int(self.occ[c][i])

    @property
    def sa(self) -> np.ndarray:
        """The whole suffix array, each place found from the sampled ones."""
        return np.array([self.locate(i) for i in range(len(self.bwt))])

    @cached_property
    def reversed(self) -> FMIndex:
        return FMIndex(self.text.removesuffix("$")[::-1])

    def locate(self, i: int) -> int:
        """Place in the text of row ``i`` of the suffix array."""
        steps = 0
        while i not in self.places:
            i, steps = self.last_to_first(i), steps + 1
        return self.places[i] + steps

    def search(self, pattern: str) -> list[int]:
        lo, hi = 0, len(self.bwt)
        for letter in reversed(pattern):
            lo, hi = self.step(letter, lo, hi)
            if lo >= hi:
                return []
        return sorted(self.locate(i) for i in range(lo, hi))

    def longest_segments(self, read: str) -> tuple[int, list[int], tuple[int, int]]:
        """Quick scan from the left: places where an exact segment breaks, and the longest segment. Segments grow to
        the right, which are steps in the index of the reversed text."""
        whole = 0, len(self.reversed.bwt)
        breaks, best, start, match = [], (0, 0), 0, whole
        for at, letter in enumerate(read):
            match = self.reversed.step(letter, *match)
            if match[0] < match[1]:
                continue
            best = max(best, (start, at), key=lambda x: (x[1] - x[0], -x[0]))
            breaks.append(at)
            start, match = at + 1, whole
        return len(breaks), breaks, max(best, (start, len(read)), key=lambda x: (x[1] - x[0], -x[0]))


class BidirectionalIndex:
    """Indexes of a text and of the reversed text, so that a match can grow at either end. A match is a triple: its rows
    in the index, its first row in the index of the reversed text, and its size."""

    def __init__(self, text: str, sample: int = 32):
        self.forward, self.backward = FMIndex(text, sample=sample), FMIndex(text[::-1], sample=sample)

    def everything(self) -> tuple[int, int, int]:
        return 0, 0, len(self.forward.bwt)

    @staticmethod
    def _grow(index: FMIndex, letter: str, low: int, other: int, size: int) -> tuple[int, int, int]:
        """One more letter in front in ``index``; in the other one the match moves behind those that go on with a smaller
        letter."""
        lo, hi = index.step(letter, low, low + size)
        smaller = sum(int(index.occ[c][low + size] - index.occ[c][low]) for c in index.alphabet if c < ord(letter))
        return lo, other + smaller, max(0, hi - lo)

    def left(self, match: tuple[int, int, int], letter: str) -> tuple[int, int, int]:
        low, other, size = match
        return self._grow(self.forward, letter, low, other, size)

    def right(self, match: tuple[int, int, int], letter: str) -> tuple[int, int, int]:
        low, other, size = match
        grown = self._grow(self.backward, letter, other, low, size)
        return grown[1], grown[0], grown[2]

    def search(self, pattern: str, start: int = 0) -> list[int]:
        """Places of ``pattern``, found from its letter ``start`` to the right and then to the left."""
        match = self.everything()
        for letter in pattern[start:]:
            match = self.right(match, letter)
        for letter in reversed(pattern[:start]):
            match = self.left(match, letter)
        return sorted(self.forward.locate(i) for i in range(match[0], match[0] + match[2]))
