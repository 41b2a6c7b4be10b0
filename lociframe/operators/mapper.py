"""Read mapping as a DataFrame pipeline.

A read with at most k differences holds, cut into k + 1 chunks, one chunk without any (pigeonhole). N in a
read matches every letter, so the chunks are cut between them. The chunks' first letters are joined with the k-mers of the reference, candidate places are deduplicated per
(read, strand, start), the reference windows come by an equi-join on (chr, tile), and only then an Arrow
batch verifies each candidate. Reads with too many N and reads without a hit come back as unmapped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociframe.functions import seq as S
from lociframe.functions.cigar import alignment_state, unclipped_size
from lociframe.operators.kernels import Scores, chunk_places, edit_align, local_align, local_alignments, local_scores, map_in_window, reverse_complement
from lociframe.session import cut_lineage, spread

TILE = 4096
SHORT_SEEDS = (12, 8, 6, 4)
SALTS = 4
HEADS = (16, 8, 4, 2, 1)
SCAN_MAX = 1 << 20
KNOWN = 20_000
SIEVE = 4_194_301  # a prime below 2^22

_CODE = np.full(256, 4, dtype=np.uint8)
_CODE[[ord(c) for c in "ACGT"]] = [0, 1, 2, 3]


def reference_tiles(reference: DataFrame, name: str, seq: str, margin: int) -> DataFrame:
    """``chr``, ``tile`` and ``text``: letters from tile * TILE - margin on, for TILE + 2 * margin letters."""
    return (
        reference.select(F.col(name).alias("chr"), S.normalized(F.col(seq)).alias("s"))
        .withColumn("tile", F.explode(F.expr(f"sequence(0, cast(floor(greatest(length(s) - 1, 0) / {TILE}) as int))")))
        .select("chr", "tile", F.greatest(F.lit(0), F.col("tile") * TILE - margin).alias("base"), F.expr(f"substring(s, greatest(0, tile * {TILE} - {margin}) + 1, {TILE} + {margin} + least({margin}, tile * {TILE}))").alias("text"))
    )


def _codes(letters: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places without N and the numbers of the k-mers there: 2 bits a letter below a 1, so that no two
    lengths share a number."""
    code = _CODE[np.frombuffer(letters, dtype=np.uint8)].astype(np.int64)
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    value = np.ones(n, dtype=np.int64)
    for i in range(k):
        value = (value << 2) | (code[i : i + n] & 3)
    bad = np.concatenate(([0], np.cumsum(code == 4)))
    at = np.flatnonzero(bad[k:] == bad[:n])
    return at, value[at]


def _sieve(seeds: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Which remainders by ``SIEVE`` the column ``kmer`` has, packed into bits, 512 KB for any number of them; and the
    values of ``size``, at most one per seed length."""
    place = F.pmod(F.col("kmer"), F.lit(SIEVE)) + 1
    rows = seeds.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"), F.collect_set("size").alias("sizes")).collect()  # at most 128 rows of 4 KB
    bits = np.zeros((SIEVE // (8 * 4096) + 1, 4096), dtype=np.uint8)
    for r in rows:
        bits[r.part - 1] = np.frombuffer(r.bits, dtype=np.uint8)
    return bits.ravel(), sorted({n for r in rows for n in r.sizes})


def _kmers(tiles: DataFrame, sizes: list[int], sieve: np.ndarray | None = None) -> DataFrame:
    """All k-mers of the reference without N, of each of the sizes: ``chr``, ``pos`` (0-based), ``kmer``. With a ``sieve``
    those that no seed can equal are left out."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if sieve is None else np.unpackbits(sieve, bitorder="little").astype(bool)
        for batch in batches:
            for n, (tile, base, text) in enumerate(zip(*[batch.column(i).to_pylist() for i in range(1, 4)])):
                for k in sizes:
                    at, value = _codes(text.encode(), k)
                    own = (at + base >= tile * TILE) & (at + base < (tile + 1) * TILE)
                    if held is not None:
                        own &= held[value % SIEVE]
                    if own.any():
                        names = batch.column(0).take(pa.array(np.full(own.sum(), n)))
                        yield pa.RecordBatch.from_arrays([names, pa.array((at[own] + base).astype(np.int32)), pa.array(value[own])], names=["chr", "pos", "kmer"])

    return tiles.mapInArrow(find, "chr string, pos int, kmer bigint")


def chunks_of(read: str, k: int, seed: int, short: Sequence[int] = SHORT_SEEDS) -> tuple[int, list[int]]:
    """Seed length and starts of k + 1 disjoint chunks without N, as long as they can be; no starts if they
    would be shorter than the least of ``short``."""
    size, starts = chunk_places(read, k, short[-1])
    used = next((x for x in (seed, *short) if x <= min(size, seed)), 0)
    return used, starts if used else []


def _seeds(both: DataFrame, k: int, seed: int, short: Sequence[int] = SHORT_SEEDS) -> DataFrame:
    """The first letters of the chunks of each read: the read, ``at``, ``kmer``, ``size``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, place, number, sizes = [], [], [], []
            for n, q in enumerate(batch.column(2).to_pylist()):
                size, starts = chunks_of(q, k, seed, short)
                for at in starts:
                    owner.append(n)
                    place.append(at)
                    number.append(int(_codes(q[at : at + size].encode(), size)[1][0]))
                    sizes.append(size)
            rows = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(rows) for i in range(3)], pa.array(place, pa.int32()), pa.array(number, pa.int64()), pa.array(sizes, pa.int32())], names=["read_id", "strand", "q", "at", "kmer", "size"])

    return both.mapInArrow(find, "read_id bigint, strand string, q string, at int, kmer bigint, size int")


def _tasks(spark: SparkSession) -> int:
    """Partitions for rows that are dealt out by their work, not by their bytes."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def candidate_windows(reads: DataFrame, reference: DataFrame, k: int, seed: int, id_col: str = "read_id", read_seq: str = "seq", ref_name: str = "name", ref_seq: str = "seq") -> DataFrame:
    """Every place of the reference in which a read may stand with at most ``k`` differences: ``read_id``, ``chr``, ``strand``,
    ``q`` (the read in the orientation of the strand), ``from`` (0-based) and ``window``.

    k-mers that many seeds and places share are spread by a salt: seeds by their read, so a repeat does not meet in
    one task.
    """
    plain = spread(reads.select(F.col(id_col).alias("read_id"), S.normalized(F.col(read_seq)).alias("fwd")))
    usable = plain.filter((F.length("fwd") > 0) & (S.base_count(F.col("fwd"), "N") <= k))
    margin = max(512, (usable.agg(F.max(F.length("fwd"))).first()[0] or 0) + 3 * k)
    tiles = reference_tiles(reference, ref_name, ref_seq, margin)
    tiles = tiles.repartition("chr", "tile")  # for the k-mers and for the join with the places
    both = usable.select("read_id", F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("fwd").alias("q")), F.struct(F.lit("-").alias("strand"), S.reverse_complement(F.col("fwd")).alias("q")))).alias("x")).select("read_id", "x.strand", "x.q")
    seeds = _seeds(both, k, seed)
    sieve, sizes = _sieve(seeds)
    salt = F.pmod(F.xxhash64("read_id", "at"), F.lit(SALTS))
    wanted = seeds.select("kmer").distinct()
    found = _kmers(tiles, sizes, sieve).join(wanted.hint("merge"), "kmer").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    places = seeds.withColumn("salt", salt).join(found.hint("merge"), ["kmer", "salt"]).select("read_id", "strand", "chr", F.greatest(F.lit(0), F.col("pos") - F.col("at")).alias("start"), "q").distinct()
    located = places.withColumn("tile", F.expr(f"cast(floor(start / {TILE}) as int)")).join(tiles.hint("merge"), ["chr", "tile"])
    windows = located.select("read_id", "chr", "strand", "q", F.greatest(F.lit(0), F.col("start") - k).alias("from"), "base", "text").select(
        "read_id", "chr", "strand", "q", "from", F.expr(f"substring(text, from - base + 1, length(q) + {3 * k})").alias("window")
    )
    return windows.repartition(_tasks(reads.sparkSession), "read_id")


def map_reads(reads: DataFrame, reference: DataFrame, k: int = 2, seed: int = 16, top: int = 1, unique_only: bool = False, id_col: str = "read_id", read_seq: str = "seq", ref_name: str = "name", ref_seq: str = "seq") -> DataFrame:
    """Best hits of each read: ``read_id``, ``chr``, ``strand``, ``start_pos`` (1-based), ``end_pos``,
    ``num_mismatches``, ``cigar``, ``score``, ``num_best_hits``, ``alignment_state``.

    ``k`` is the number of differences allowed and ``seed`` at most 31; reads without k + 1 chunks of ``seed`` letters
    between their N are seeded with shorter k-mers, and only those without k + 1 chunks of four letters are
    not placed. Ties are ordered by chr, start, strand. Reads with more than ``k`` N, null, empty and unmapped
    reads come back once with chr ``*`` and state N.
    ``unique_only`` keeps uniquely mapped reads only, others count as unmapped.
    """
    plain = reads.select(F.col(id_col).alias("read_id"))
    window = candidate_windows(reads, reference, k, seed, id_col, read_seq, ref_name, ref_seq)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for read, chr_, strand, q, base, text in part.itertuples(index=False):
                a = edit_align(text, q, k, raw_limit=k)
                if a:
                    matched = sum(n for op, n in a.ops if op in "MI")
                    out.append((read, chr_, strand, base + a.position + 1, a.differences, a.cigar, matched - 3 * a.differences))
            yield pd.DataFrame(out, columns=["read_id", "chr", "strand", "start_pos", "num_mismatches", "cigar", "score"])

    hits = window.mapInPandas(verify, "read_id bigint, chr string, strand string, start_pos int, num_mismatches int, cigar string, score int").groupBy("read_id", "chr", "strand", "start_pos").agg(
        F.max(F.struct("score", (-F.col("num_mismatches")).alias("less"), "cigar")).alias("b")
    ).select("read_id", "chr", "strand", "start_pos", (-F.col("b.less")).alias("num_mismatches"), "b.cigar", "b.score")
    hits = cut_lineage(hits)  # verified once, used for the chosen and the missing reads
    if top == 1:
        place = F.min(F.struct("num_mismatches", "chr", "start_pos", "strand", "cigar")).alias("b")
        alike = hits.groupBy("read_id", "score").agg(place, F.count(F.lit(1)).cast("int").alias("num_best_hits"))
        chosen = alike.groupBy("read_id").agg(F.max("score").alias("score"), F.max_by("b", "score").alias("b"), F.max_by("num_best_hits", "score").alias("num_best_hits"))
        chosen = chosen.select("read_id", "b.chr", "b.strand", "b.start_pos", "b.num_mismatches", "b.cigar", "score", "num_best_hits")
    else:
        w = Window.partitionBy("read_id")
        chosen = (
            hits.withColumn("num_best_hits", F.sum(F.when(F.col("score") == F.max("score").over(w), 1).otherwise(0)).over(w).cast("int"))
            .withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "num_mismatches", "chr", "start_pos", "strand"))).filter(F.col("r") <= top).drop("r")
        )
    if unique_only:
        chosen = chosen.filter("num_best_hits = 1")
    chosen = chosen.withColumns({"end_pos": F.col("start_pos") + unclipped_size(F.col("cigar")), "alignment_state": alignment_state(F.col("num_best_hits"))})
    missing = plain.select("read_id").join(chosen.select("read_id").distinct(), "read_id", "left_anti").select(
        "read_id", F.lit("*").alias("chr"), F.lit("+").alias("strand"), F.lit(0).alias("start_pos"), F.lit(None).cast("int").alias("num_mismatches"), F.lit(None).cast("string").alias("cigar"), F.lit(0).alias("score"),
        F.lit(0).alias("num_best_hits"), F.lit(0).alias("end_pos"), F.lit("N").alias("alignment_state"),
    )
    return chosen.unionByName(missing)


def align_to_text(df: DataFrame, query: str, text: str, k: int = 2) -> DataFrame:
    """``df`` with ``hit``: the best placement of each query in one given text, clips and splits included
    (strand, start_pos, cigar, num_mismatches, score and the split segment); null without one."""
    segment = "strand string, start_pos int, cigar string, num_mismatches int"

    @F.pandas_udf(f"{segment}, score int, split_start int, split_cigar string")
    def place(queries: pd.Series) -> pd.DataFrame:
        rows = []
        for q in queries:
            hits = map_in_window(q, text, k) if q else []
            h = hits[0] if hits else None
            rows.append((h.strand, h.start, h.cigar, h.differences, h.score, h.split.start if h.split else None, h.split.cigar if h.split else None) if h else (None,) * 7)
        return pd.DataFrame(rows, columns=["strand", "start_pos", "cigar", "num_mismatches", "score", "split_start", "split_cigar"])

    return df.withColumn("hit", place(F.col(query)))


def align_to_reference(reads: DataFrame, reference: DataFrame, k: int = 2, seed: int = 16, id_col: str = "read_id", read_seq: str = "s", ref_name: str = "name", ref_seq: str = "s") -> DataFrame:
    """Best placement of each read in the sequences of a reference, clips and splits included: ``read_id``,
    ``chr``, ``end_pos`` and the fields of :func:`align_to_text`, null without one, and ``split``, the second segment as a
    record, where the two ends of a read stand apart. Ties are ordered by mismatches, chr.

    Each placement of ``map_in_window`` has at most ``k`` differences in all or holds one end of the read,
    half of it or more, exactly. So sequences that share a chunk of the whole, or the longest stretch without N of a
    half, are searched in full, and no others can have one. Reads without N-free stretches of four letters have none.
    Chunks under ``seed`` letters are sought whole. No join is left to Spark's estimates, which take the k-mers of a
    compressed file for small and would send them all through the driver.
    """
    both = reads.filter(F.length(read_seq) > 0).select(F.col(id_col).alias("read_id"), F.explode(F.array(F.col(read_seq), S.reverse_complement(F.col(read_seq)))).alias("q"))
    half = F.expr("cast(ceil(length(q) / 2) as int)")
    part = lambda q: both.select("read_id", F.lit("+").alias("strand"), q.alias("q"))
    seeds = _seeds(part(F.col("q")), k, seed, range(seed - 1, SHORT_SEEDS[-1] - 1, -1)).unionByName(_seeds(part(F.substring("q", F.lit(1), half)).unionByName(part(F.substring("q", F.length("q") - half + 1, half))), 0, seed)).select("read_id", "kmer", "size")
    seeds = cut_lineage(seeds.distinct())
    sieve, sizes = _sieve(seeds)
    texts = reference.select(F.col(ref_name).alias("chr"), F.col(ref_seq).alias("text"))
    near = seeds.join(_kmers(reference_tiles(reference, ref_name, ref_seq, 512), sizes, sieve).hint("merge"), "kmer").select("read_id", "chr").distinct()
    pairs = near.join(reads.select(F.col(id_col).alias("read_id"), F.col(read_seq).alias("q")).hint("merge"), "read_id").join(texts.hint("merge"), "chr")
    segment = "strand string, start_pos int, cigar string, num_mismatches int, score int, split_start int, split_cigar string"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for read, chr_, q, text in batch.itertuples(index=False):
                hits = map_in_window(q, text, k)
                if hits:
                    h = hits[0]
                    rows.append((read, chr_, h.strand, h.start, h.cigar, h.differences, h.score, h.split.start if h.split else None, h.split.cigar if h.split else None))
            yield pd.DataFrame(rows, columns=["read_id", "chr", *[x.split()[0] for x in segment.split(", ")]]).astype({"split_start": "Int32"})

    found = pairs.select("read_id", "chr", "q", "text").repartition(_tasks(reads.sparkSession), "read_id", "chr").mapInPandas(place, f"read_id bigint, chr string, {segment}")
    rest = [c for c in found.columns if c not in ("read_id", "score", "num_mismatches", "chr")]
    best = found.groupBy("read_id").agg(F.min(F.struct((-F.col("score")).alias("less"), "num_mismatches", "chr", *rest)).alias("b")).select("read_id", *[f"b.{c}" for c in ("chr", "strand", "start_pos", "cigar", "num_mismatches")], (-F.col("b.less")).alias("score"), "b.split_start", "b.split_cigar")
    second = F.struct("chr", "strand", F.col("split_start").alias("start_pos"), (F.col("split_start") + unclipped_size(F.col("split_cigar"))).alias("end_pos"), F.col("split_cigar").alias("cigar"), F.lit(0).alias("num_mismatches"))
    best = best.withColumns({"end_pos": F.col("start_pos") + unclipped_size(F.col("cigar")), "split": F.when(F.col("split_start").isNotNull(), second)})
    return reads.select(F.col(id_col).alias("read_id")).distinct().join(best.hint("merge"), "read_id", "left")


def best_local_hits(reads: DataFrame, reference: DataFrame, k: int = 2, seed: int = 16, scores: Scores | None = None, **names) -> DataFrame:
    """Best local alignment of each read with the windows of the reference that its seeds lead to: ``read_id``, ``chr``,
    ``strand``, ``start_pos`` (1-based), ``cigar``, ``score``, ``num_mismatches``. Ties are ordered by mismatches, chr, place and
    strand. Reads without a window have no row.

    All windows are scored, and those with the best score of their read are aligned."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}
        known: dict = {}
        for batch in batches:
            read, chr_, strand, q, base, window = (c.to_pylist() for c in batch.columns)
            found = local_scores(window, q, scores).tolist()
            for r, x in zip(read, found):
                if x > top.get(r, 0):
                    top[r] = x
            chosen = [i for i, (r, x) in enumerate(zip(read, found)) if x and x == top[r]]  # others are not the best of their read
            if len(known) > KNOWN:
                known.clear()
            new = list({(window[i], q[i]) for i in chosen} - known.keys())  # repeats give equal pairs
            known.update(zip(new, local_alignments([w for w, _ in new], [x for _, x in new], scores)))
            rows = []
            for i in chosen:
                a = known[window[i], q[i]]
                rows.append((read[i], chr_[i], strand[i], base[i] + a.position + 1, a.cigar, a.score, a.differences))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], names=["read_id", "chr", "strand", "start_pos", "cigar", "score", "num_mismatches"])

    kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
    found = candidate_windows(reads, reference, k, seed, **names).mapInArrow(align, "read_id bigint, chr string, strand string, start_pos int, cigar string, score int, num_mismatches int")
    best = F.min(F.struct((-F.col("score")).alias("less"), "num_mismatches", "chr", "start_pos", "strand", "cigar")).alias("b")
    return found.groupBy("read_id").agg(best).select("read_id", "b.chr", "b.strand", "b.start_pos", "b.cigar", (-F.col("b.less")).alias("score"), "b.num_mismatches")


def smith_waterman(query: Column, window: Column, scores: Scores | None = None, banded: bool = False, both_strands: bool = True) -> Column:
    """Local alignment of each query with its own window; of both strands the one with fewer differences
    (forward on ties): struct of strand, position (0-based), cigar, score, num_mismatches."""

    @F.pandas_udf("strand string, position int, cigar string, score int, num_mismatches int")
    def align(queries: pd.Series, windows: pd.Series) -> pd.DataFrame:
        rows = []
        for q, w in zip(queries, windows):
            options = []
            for strand in ("+", "-") if both_strands else ("+",):
                a = local_align(w, q if strand == "+" else reverse_complement(q), scores, banded) if q and w else None
                if a:
                    clipped = sum(n for op, n in a.ops if op == "S")
                    options.append((a.differences + clipped, strand != "+", (strand, a.position, a.cigar, a.score, a.differences)))
            rows.append(min(options)[2] if options else (None,) * 5)
        return pd.DataFrame(rows, columns=["strand", "position", "cigar", "score", "num_mismatches"])

    return align(query, window)


def trim_adapter(reads: DataFrame, adapter: str, k: int = 3, min_length: int = 20, pairs: tuple[str, str] = ("seq_1", "seq_2")) -> DataFrame:
    """Pairs cut at the start of the adapter (or its reverse complement) in both mates: the input columns,
    ``cut_1`` and ``cut_2``. Pairs in which a mate lacks the adapter within ``k`` differences, or is shorter
    than ``min_length`` before it, are left out."""

    @F.pandas_udf("int")
    def adapter_at(seqs: pd.Series) -> pd.Series:
        out = []
        for s in seqs:
            a = None
            for form in (adapter, reverse_complement(adapter)):
                a = edit_align(s, form, k, raw_limit=k) if s else None
                if a:
                    break
            out.append(a.position if a else None)
        return pd.Series(out, dtype="Int32")

    cut = reads.withColumns({"cut_1": adapter_at(F.col(pairs[0])), "cut_2": adapter_at(F.col(pairs[1]))})
    return cut.filter((F.col("cut_1") >= min_length) & (F.col("cut_2") >= min_length))


def to_records(hits: DataFrame, reads: DataFrame, id_col: str = "read_id") -> DataFrame:
    """Hits as alignment records: letters and qualities in the orientation of the strand (reversed, letters
    also complemented, on ``-``), ``split`` null unless the hits have one. Hits of unknown reads keep null
    letters."""
    r = reads.select(F.col(id_col).alias("__r"), F.col("name").alias("read_name"), S.normalized(F.col("seq")).alias("__s"), F.col("qual").alias("__q"))
    joined = hits.join(r, F.col(id_col) == F.col("__r"), "left")
    back = F.col("strand") == "-"
    none = F.lit(None).cast("struct<chr:string,strand:string,start_pos:int,end_pos:int,cigar:string,num_mismatches:int>")
    return joined.withColumns({
        "query_seq": F.when(back, S.reverse_complement(F.col("__s"))).otherwise(F.col("__s")), "qual": F.when(back, F.reverse("__q")).otherwise(F.col("__q")),
        "split": F.col("split") if "split" in hits.columns else none,
    }).drop("__r", "__s", "__q")


def _numbers(letters: str, k: int) -> np.ndarray:
    """Numbers of all k-mers, N being a letter like others; k is at most 16."""
    code = _CODE[np.frombuffer(letters.encode(), dtype=np.uint8)].astype(np.int64)
    n = max(0, len(code) - k + 1)
    value = np.zeros(n, dtype=np.int64)
    for i in range(k):
        value = value * 5 + code[i : i + n]
    return value


def exact_places(queries: DataFrame, texts: DataFrame, id_col: str = "read_id", query: str = "s", offset: str = "offset", text: str = "s") -> DataFrame:
    """Places of whole queries in many texts, each place counted from the text's ``offset``: id and ``pos``.

    The first letters of a query, 16 or the next fewer of ``HEADS``, are joined with those at every place of the
    texts, and the rest is compared where they meet. An N stands for itself only. Null and empty queries have no
    place.
    """
    held = spread(queries.filter(F.length(query) > 0).select(F.col(id_col).alias("id"), F.col(query).alias("q")))
    size = F.coalesce(*[F.when(F.length("q") >= n, n) for n in HEADS])
    sizes = sorted(r[0] for r in held.select(size.alias("n")).distinct().collect())  # at most one per size
    margin = max(512, held.agg(F.max(F.length("q"))).first()[0] or 0)
    cut = texts.select(F.col(offset).cast("bigint").alias("offset"), F.col(text).alias("t")).withColumn("tile", F.explode(F.expr(f"sequence(0, cast(floor(greatest(length(t) - 1, 0) / {TILE}) as int))")))
    tiles = cut.select("offset", "tile", F.expr(f"substring(t, tile * {TILE} + 1, {TILE + margin})").alias("t")).repartition("offset", "tile")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, q, max(n for n in HEADS if n <= len(q))) for i, q in zip(*[c.to_pylist() for c in batch.columns])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for *_, n in rows], pa.int32()), pa.array([int(_numbers(q[:n], n)[0]) for _, q, n in rows], pa.int64())], names=["id", "q", "size", "head"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, t in enumerate(batch.column(2).to_pylist()):
                for k in sizes:
                    head = _numbers(t, k)[:TILE]
                    if len(head):
                        own = pa.array(np.full(len(head), n))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(np.arange(len(head), dtype=np.int32)), pa.array(np.full(len(head), k, dtype=np.int32)), pa.array(head)], names=["offset", "tile", "at", "size", "head"])

    wanted = held.mapInArrow(heads, f"id {queries.schema[id_col].dataType.simpleString()}, q string, size int, head bigint")
    met = tiles.mapInArrow(every, "offset bigint, tile int, at int, size int, head bigint").join(wanted, ["size", "head"]).join(tiles, ["offset", "tile"])
    return met.filter(F.expr("substring(t, at + 1, length(q)) = q")).select(F.col("id").alias(id_col), F.expr(f"offset + tile * {TILE}L + at").alias("pos"))


def quick_scan(df: DataFrame, query: str, text: str) -> DataFrame:
    """``df`` with ``scan``: how often a greedy left-to-right exact match in ``text`` breaks, and the longest
    segment (start, end) that stands in it; and ``hits``, the places of the whole query (0-based). The index of the text
    goes to every task, so a text has at most ``SCAN_MAX`` letters; :func:`exact_places` searches longer ones."""
    from lociframe.operators.textindex import FMIndex

    if len(text) > SCAN_MAX:
        raise ValueError(f"a text of over {SCAN_MAX} letters is no text for one task")
    index = FMIndex(text)

    @F.pandas_udf("breaks int, start int, end int, hits array<int>")
    def scan(queries: pd.Series) -> pd.DataFrame:
        rows = []
        for q in queries:
            if q is None:
                rows.append((None, None, None, None))
            else:
                n, _, (a, b) = index.longest_segments(q)
                rows.append((n, a, b, index.search(q) if q else []))
        return pd.DataFrame(rows, columns=["breaks", "start", "end", "hits"])

    return df.withColumn("scan", scan(F.col(query)))
