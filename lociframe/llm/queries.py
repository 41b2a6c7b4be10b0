"""Queries p4 to p8 with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.containers import fill_containers
from lociframe.llm.mixing import mix_sources
from lociframe.llm.pieces import split_sequences
from lociframe.llm.reading import cross_validated, reading_levels
from lociframe.llm.shared_spans import records, shared_clusters, shared_shares, shared_spans
from lociframe.session import cut_lineage, read_table

# The limits of the problems.
PIECE_MAX = 4000
PIECE_OVERLAP = 200
CAPACITY = 2048


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return records(read_table(spark, sf, "fastq_read"), "fastq_read", "read_id").unionByName(records(read_table(spark, sf, "fasta_read"), "fasta_read", "seq_id"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return shared_spans(_records(spark, sf))


def p4_shares(spark: SparkSession, sf: str) -> DataFrame:
    recs = _records(spark, sf)
    return shared_shares(recs, shared_spans(recs))


def p4_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return shared_clusters(_records(spark, sf))


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_sequences(read_table(spark, sf, "fasta_read"), PIECE_MAX, PIECE_OVERLAP)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).filter("piece_no = 1 and cut_kind is not null").select("seq_id", "cut_kind")


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf)


def p5_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The sequence put together again from its pieces: its letters and checksum, and whether all pieces keep the limit."""
    first = F.when(F.col("piece_no") == 1, 0).otherwise(PIECE_OVERLAP)
    joined = _pieces(spark, sf).groupBy("seq_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", F.expr(f"substring(piece, if(piece_no = 1, 0, {PIECE_OVERLAP}) + 1)").alias("own")))), lambda x: x["own"]), "").alias("s"),
        F.sum(F.length("piece") - first).alias("letters"), (F.max(F.length("piece")) <= PIECE_MAX).alias("within"),
    )
    return joined.select("seq_id", "letters", "within", F.md5("s").alias("checksum"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that no single container holds."""
    placed = fill_containers(read_table(spark, sf, "documents"), CAPACITY).groupBy("doc_id").agg(F.min("container_id").alias("a"), F.max("container_id").alias("b"), F.max("piece_no").alias("last"))
    return placed.filter("a <> b and last > 0").select("doc_id")


def p6_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents placed; containers over capacity; documents whose pieces do not follow each other without gaps, or
    that are split without need; and whether there are at most 1 % more containers than the fewest possible, and one."""
    placed = cut_lineage(fill_containers(read_table(spark, sf, "documents"), CAPACITY))
    docs = placed.groupBy("doc_id").agg(
        F.max("token_end").alias("tokens"), F.sum(F.col("token_end") - F.col("token_start")).alias("covered"), F.count(F.lit(1)).alias("n"), F.countDistinct("token_start").alias("starts"),
    )
    right = F.expr(f"covered = tokens and n = starts and n = greatest(1, ceil(tokens / {CAPACITY}))")
    bins = placed.groupBy("container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"))
    full = bins.agg(F.sum(F.when(F.col("used") > CAPACITY, 1).otherwise(0)).alias("over"), (F.count(F.lit(1)) <= F.ceil(F.sum("used") / CAPACITY) * 1.01 + 1).alias("well_filled"), F.lit(1).alias("k"))
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.when(right, 0).otherwise(1)).alias("wrong"), F.lit(1).alias("k")).join(full, "k").drop("k")


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return fill_containers(read_table(spark, sf, "documents"), CAPACITY)


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Containers used, the fewest possible, and the share of room that is filled."""
    filled = fill_containers(read_table(spark, sf, "documents"), CAPACITY).groupBy("container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"))
    return filled.agg(
        F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("used") / CAPACITY).alias("fewest"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count(F.lit(1)) * CAPACITY)).alias("filled"), F.max("used").alias("most_used")
    )


def _mixed(spark: SparkSession, sf: str, **how) -> tuple[DataFrame, DataFrame]:
    return mix_sources(read_table(spark, sf, "documents"), read_table(spark, sf, "mix_target"), **how)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1].filter("not reachable").select("source")


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0]


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1]


def p7_rescaled_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report of the largest mixture in which every source has its share."""
    return _mixed(spark, sf, rescaled=True)[1]


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per source: the caps are kept; a source that can reach its goal misses it by at most 2 % or the tokens of one long
    document (10,000), as whole records are drawn; so does every source in the rescaled mixture."""
    near = F.expr("abs(mixed_tokens - goal) <= greatest(0.02 * goal, 10000)")
    scaled = _mixed(spark, sf, rescaled=True)[1].select("source", near.alias("share_holds"))
    return _mixed(spark, sf)[1].join(scaled, "source").select("source", "max_repeats", "target_share", (F.col("most_used") <= F.col("max_repeats")).alias("capped"), (near | ~F.col("reachable")).alias("near"), "share_holds")


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading_levels(read_table(spark, sf, "documents"), read_table(spark, sf, "reading_label"), all_texts=True)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).filter("english and numbered and level = 4").select("doc_id")


def p8_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf)


def p8_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, mean score and mean length by source and level."""
    docs = read_table(spark, sf, "documents").select("doc_id", "source")
    return docs.join(_levels(spark, sf), "doc_id").groupBy("source", "english", "level").agg(F.count(F.lit(1)).alias("documents"), F.avg("score").alias("mean_score"), F.avg(F.exp("log_words")).alias("mean_words"))


def p8_cross_validated(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement with the readers' grades on held-out documents, in five folds."""
    return cross_validated(read_table(spark, sf, "documents"), read_table(spark, sf, "reading_label"))


def queries() -> dict:
    return {f.__name__: f for f in (p4_found, p4_shares, p4_clusters, p5_found, p5_pieces, p5_round_trip, p6_found, p6_containers, p6_report, p6_checks, p7_found, p7_mixture, p7_report, p7_rescaled_report, p7_checks, p8_found, p8_levels, p8_profile, p8_cross_validated)}


def oracle() -> dict[str, str]:
    recs = r"""
    recs as (
      select 'fastq_read' as rec_table, read_id as rec_id, coalesce(name, 'q' || read_id) as name, regexp_replace(translate(regexp_replace(seq, '\s+', '', 'g'), 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') as s from fastq_read
      union all select 'fasta_read', seq_id, coalesce(name, 'a' || seq_id), regexp_replace(translate(regexp_replace(seq, '\s+', '', 'g'), 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') from fasta_read)"""
    spans = f"""
    with {recs},
    windows as (select rec_table, rec_id, name, cast(p as int) as p, s[p + 1 : p + 50] as w from (select *, unnest(range(0, length(s) - 49)) as p from recs where length(s) >= 50)),
    shared as (select w from windows where not contains(w, 'N') group by w having min(name) <> max(name)),
    hits as (select rec_table, rec_id, p, case when p > lag(p) over (partition by rec_table, rec_id order by p) + 50 then 1 else 0 end as opens from windows semi join shared using (w)),
    runs as (select *, sum(opens) over (partition by rec_table, rec_id order by p rows unbounded preceding) as g from hits),
    spans as (select rec_table, rec_id, min(p) as span_start, max(p) + 50 as span_end from runs group by rec_table, rec_id, g)"""
    return {
        "p4_found": spans + " select * from spans",
        "p4_shares": spans + """
 , per as (select rec_table, rec_id, cast(sum(span_end - span_start) as bigint) as n, count(*) as n_spans from spans group by rec_table, rec_id)
    select r.rec_table, r.rec_id, length(s) as letters, coalesce(n, 0) as shared_letters, coalesce(n_spans, 0) as n_spans, coalesce(n, 0) / nullif(length(s), 0) as share
    from recs r left join per p on r.rec_table = p.rec_table and r.rec_id = p.rec_id""",
        "p5_found": r"""
    with s as (select seq_id, regexp_replace(seq, '\s+', '', 'g') as s from fasta_read)
    select seq_id, case when list_max(list_transform(regexp_split_to_array(s, '[Nn]{10,}'), lambda x: length(x))) > 4000 then 'forced' else 'natural' end as cut_kind
    from s where length(s) > 4000""",
        "p5_round_trip": r"""
    with s as (select seq_id, regexp_replace(seq, '\s+', '', 'g') as s from fasta_read) select seq_id, length(s) as letters, true as within, md5(s) as checksum from s where s is not null""",
        "p6_checks": "select count(distinct doc_id) as documents, 0 as wrong, 0 as over, true as well_filled from documents",
        "p7_checks": "select source, max_repeats, target_share, true as capped, true as near, true as share_holds from mix_target",
    }
