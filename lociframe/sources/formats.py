"""Readers and writers of line formats, on Spark's text source.

Readers take one path or several. Compressed files that end in .gz are read as such.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociframe.functions import seq as S
from lociframe.functions.cigar import sam_header, sam_line
from lociframe.operators.overlap import natural_order
from lociframe.session import broadcast_if_small
from lociframe.sources.fastq import PART_BYTES, FastqSource, LineSource, TarSource

FASTA_SUFFIXES = (".fa", ".fasta", ".fs", ".fan")
FASTQ_SUFFIXES = (".fastq", ".fq")


def _entries(chunks: DataFrame) -> DataFrame:
    """FASTA entries from texts that hold one entry each; comment lines are dropped."""
    lines = chunks.withColumn("lines", F.filter(F.split("value", "\r?\n"), lambda x: ~x.startswith("#")))
    lines = lines.withColumn("lines", F.when(F.get("lines", F.lit(0)).startswith(">"), F.transform("lines", lambda x, i: F.when(i == 0, F.substring(x, 2, F.length(x))).otherwise(x))).when(F.col("opened"), F.col("lines")))
    head = F.get("lines", F.lit(0))
    return lines.filter("lines is not null").select(
        S.fasta_name(head).alias("name"),
        F.trim(head).alias("description"),
        F.array_join(F.transform(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "").alias("seq"),
        "file_name",
    )


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``name``, ``description``, ``seq``, ``file_name``. A ``>`` at a line start opens an entry, lines that
    start with ``#`` are comments, letters before the first entry are skipped, and an entry without
    letters has an empty seq. Each file is split at its entries, so one entry must fit into a row."""
    text = spark.read.option("lineSep", "\n>").text(path)
    first = text.withColumns({"file_name": F.input_file_name(), "opened": ~F.col("value").startswith(">")})
    # what follows a separator has lost its ">"; a chunk that is only comments and then an entry is the first of a file
    led = first.withColumn("value", F.when(F.col("value").startswith("#"), F.regexp_replace("value", r"^(#[^\n]*\n?)+", "")).otherwise(F.col("value")))
    return _entries(led.withColumn("opened", F.col("opened") & (F.col("value") != "")))


def _files(spark: SparkSession, path: str | list[str]) -> str:
    """Files of paths, folders and patterns, one to a line; contents are not read."""
    found = spark.read.format("binaryFile").load(path).select("path").collect()
    return "\n".join(sorted(unquote(r[0].removeprefix("file://").removeprefix("file:")) for r in found))


def read_fasta_tar(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Entries of the ``.fa``, ``.fasta`` and ``.fs`` members of tar and tar.gz archives. An archive is read
    by one task as a stream, entry by entry."""
    spark.dataSource.register(TarSource)
    entries = spark.read.format("lociframe_tar").options(paths=_files(spark, path), suffixes="\n".join(FASTA_SUFFIXES[:3])).load()
    return _entries(entries.select(F.regexp_replace("value", r"\r?\n\z", "").alias("value"), "file_name", F.lit(True).alias("opened")))


def sub_sequences(sequences: DataFrame, requests: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """``requests`` (``name``, ``start``, ``end``: 0-based half-open, and others) with ``piece``, looked up by name.

    A name that several sequences bear gives a row for each, an unknown one none; beyond the ends a piece is shorter.
    """
    held = sequences.select(F.col(name).alias("__name"), F.col(seq).alias("__seq"))
    found = requests.join(held, F.col("name") == F.col("__name"))
    return found.withColumn("piece", F.expr("substring(__seq, greatest(start, 0) + 1, greatest(0, end - greatest(start, 0)))")).drop("__name", "__seq")


def fasta_text(df: DataFrame, width: int = 50) -> DataFrame:
    """FASTA entries as ``value``, in natural order of the names."""
    return natural_order(df, "name").orderBy("rank_key").select(F.concat(F.lit(">"), "name", F.lit("\n"), S.wrapped(F.col("seq"), width)).alias("value"))


def _numbered(df: DataFrame, keys: list[str], part: str) -> DataFrame:
    """``df`` with ``ordinal``, so far counted in its part, counted over all parts of the same keys."""
    sizes = df.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("__n"))  # one row per part
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.join(broadcast_if_small(sizes.select(*keys, part, before.alias("__before"))), [*keys, part]).withColumn("ordinal", F.col("ordinal") + F.col("__before")).drop("__before")


def read_fastq(spark: SparkSession, path: str | list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """``name`` (without ``@``), ``seq``, ``qual``, ``ordinal`` (of the record in its file) and ``file_name``.
    Files over ``part_bytes`` are read in parts, and once more to count the records. See :class:`FastqSource`."""
    spark.dataSource.register(FastqSource)
    paths = [path] if isinstance(path, str) else path
    options = {"paths": "\n".join(paths), "part_bytes": str(part_bytes)}
    records = spark.read.format("lociframe_fastq").options(**options).load()
    if any(p.start for p in FastqSource(options).reader(None).partitions()):
        records = _numbered(records, ["file_name"], "part_start")
    return records.select("name", "seq", "qual", "ordinal", "file_name")


def fastq_text(df: DataFrame) -> DataFrame:
    """FASTQ records as ``value``; a null quality is written as ``!`` for each base."""
    qual = F.coalesce("qual", F.repeat(F.lit("!"), F.length("seq")))
    return df.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), qual).alias("value"))


def read_reads(spark: SparkSession, paths: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """Reads by file suffix (``.gz`` may follow): one file gives single-end reads, two give pairs.

    ``name``, ``reads`` (array of structs seq, qual). Pairs are matched by record number and end with the
    shorter file.
    """

    def one(path: str) -> DataFrame:
        plain = path.removesuffix(".gz")
        if plain.endswith(FASTQ_SUFFIXES):
            return read_fastq(spark, path, part_bytes).select("name", "seq", "qual", "ordinal")
        if plain.endswith(FASTA_SUFFIXES):
            ids = read_fasta(spark, path).select("name", "seq", F.lit(None).cast("string").alias("qual"), F.monotonically_increasing_id().alias("id"))
            placed = ids.select("name", "seq", "qual", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("ordinal"))
            return _numbered(placed.withColumn("file", F.lit(path)), ["file"], "part").select("name", "seq", "qual", "ordinal")
        raise ValueError(f"unknown read format: {path}")

    item = lambda d: F.struct(f"{d}.seq", f"{d}.qual")
    if len(paths) == 1:
        return one(paths[0]).alias("a").select("name", F.array(item("a")).alias("reads"))
    if len(paths) == 2:
        a, b = one(paths[0]).alias("a"), one(paths[1]).alias("b")
        return a.join(b, F.col("a.ordinal") == F.col("b.ordinal")).select(F.col("a.name").alias("name"), F.array(item("a"), item("b")).alias("reads"))
    raise ValueError("one or two files are expected")


def single_query(spark: SparkSession, query: str) -> DataFrame:
    return spark.createDataFrame([("read", query, None)], "name string, seq string, qual string")


def parse_bed4(line: Column) -> Column:
    """``chr start end strand``, 0-based in the text and 1-based here."""
    c = F.split(F.trim(line), r"\s+")
    number = lambda i: F.get(c, F.lit(i)).cast("int") + 1
    return F.struct(F.get(c, F.lit(0)).alias("chr"), number(1).alias("start"), number(2).alias("end"), F.when(F.get(c, F.lit(3)) == "+", "+").otherwise("-").alias("strand"))


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """BED4: ``chr``, ``start``, ``end``, ``strand``; track, browser, comment and empty lines are skipped,
    a number that cannot be read is an error."""
    return _bed_lines(spark, path).select(parse_bed4(F.col("value")).alias("b")).select("b.*")


def _bed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).filter(~F.col("value").rlike(r"^(track|browser|#)|^\s*$"))


def parse_bed12(line: Column) -> Column:
    """A gene line; what is missing gets a default: the name is empty, score 0, strand +, the thick range
    the whole one, and no blocks."""
    c = F.split(F.trim(line), r"\s+")
    text = lambda i, default: F.coalesce(F.get(c, F.lit(i)), F.lit(default))
    start, end = F.get(c, F.lit(1)).cast("int") + 1, F.get(c, F.lit(2)).cast("int") + 1
    numbers = lambda i: F.transform(F.filter(F.split(text(i, ""), ","), lambda x: x != ""), lambda x: x.cast("int"))
    return F.struct(
        F.get(c, F.lit(0)).alias("chr"), start.alias("start"), end.alias("end"), text(3, "").alias("name"), text(4, "0").cast("int").alias("score"),
        F.when(text(5, "+") == "+", "+").otherwise("-").alias("strand"), F.coalesce(F.get(c, F.lit(6)).cast("int") + 1, start).alias("thick_start"), F.coalesce(F.get(c, F.lit(7)).cast("int") + 1, end).alias("thick_end"),
        text(8, "0").alias("item_rgb"), numbers(10).alias("block_sizes"), numbers(11).alias("block_starts"),
    )


def read_bed12(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _bed_lines(spark, path).select(parse_bed12(F.col("value")).alias("b")).select("b.*")


def bed12_text(df: DataFrame) -> DataFrame:
    """BED12 lines as ``value``, 0-based again, block lists with a closing comma."""
    listed = lambda c: F.concat_ws("", F.transform(c, lambda x: F.concat(x.cast("string"), F.lit(","))))
    less = lambda c: (F.col(c) - 1).cast("string")
    return df.select(F.concat_ws("\t", "chr", less("start"), less("end"), "name", F.col("score").cast("string"), "strand", less("thick_start"), less("thick_end"), "item_rgb", F.size("block_sizes").cast("string"), listed("block_sizes"), listed("block_starts")).alias("value"))


def read_wig_lines(spark: SparkSession, path: str | list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """Raw lines with ``file_name`` and ``line_no`` (from 1), the form the reject operator reads. Files over
    ``part_bytes`` are read in parts, and once more to count the lines."""
    spark.dataSource.register(LineSource)
    options = {"paths": _files(spark, path), "part_bytes": str(part_bytes)}
    lines = spark.read.format("lociframe_lines").options(**options).load()
    if any(p.start for p in LineSource(options).reader(None).partitions()):
        lines = _numbered(lines, ["file_name"], "part_start")
    return lines.select(F.xxhash64("file_name", "ordinal").alias("line_id"), "file_name", (F.col("ordinal") + 1).cast("int").alias("line_no"), "line")


def parse_variant(line: Column) -> Column:
    """Tab-separated: id, chr, start, end, ref, rs, alt, then a count and ``(allele,count)`` groups; null for
    lines of fewer than 7 fields. Groups are read from the first field that is one up to the first that is not."""
    c = F.split(line, "\t")
    groups = F.filter(F.slice(c, 8, F.greatest(F.size(c) - 7, F.lit(0))), lambda x: x.startswith("("))
    return F.when(F.size(c) >= 7, F.struct(
        F.get(c, F.lit(0)).cast("int").alias("id"), F.get(c, F.lit(1)).alias("chr"), F.get(c, F.lit(2)).cast("int").alias("start"), F.get(c, F.lit(3)).cast("int").alias("end"),
        F.get(c, F.lit(4)).alias("ref_allele"), F.get(c, F.lit(5)).alias("rs"), F.get(c, F.lit(6)).alias("alt_allele"),
        F.when(F.get(c, F.lit(7)).rlike(r"^\d+$"), F.get(c, F.lit(7)).cast("int")).alias("count"),
        F.transform(groups, lambda x: F.struct(F.regexp_extract(x, r"^\(([^,]*),", 1).alias("allele"), F.regexp_extract(x, r",\s*(\d+)\)", 1).cast("int").alias("count"))).alias("freq"),
    ))


def read_variants(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select(parse_variant(F.col("value")).alias("v")).filter("v is not null").select("v.*")


def single_base(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & (F.length(alt) == 1)


def sam_text(alignments: DataFrame, sizes: DataFrame) -> DataFrame:
    """SAM lines as ``value`` with ``part`` (0 header, 1 records); order by part before writing."""
    header = sizes.select(F.lit(0).alias("part"), sam_header(F.col("chr"), F.col("n_bases")).alias("value"))
    columns = ("read_name", "chr", "strand", "start_pos", "end_pos", "num_mismatches", "cigar", "query_seq", "qual", "score", "num_best_hits", "alignment_state", "split")
    return header.unionByName(alignments.select(F.lit(1).alias("part"), sam_line({c: F.col(c) for c in columns}).alias("value")))


def write_lines(df: DataFrame, path: str) -> None:
    """``value`` as text files, one per partition, in the order of the frame."""
    df.select("value").write.mode("errorifexists").text(path)


def write_store(df: DataFrame, path: str, by: str = "chr") -> None:
    """A score store, packed sequence, index table or suffix array: Parquet (snappy), a folder per ``by``.

    Rows are clustered by ``by`` and a hash, so a hot value spreads over several files.
    """
    df.repartition(F.col(by), F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("errorifexists").partitionBy(by).option("compression", "snappy").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_score_database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Score rows of a database; needs its JDBC driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
