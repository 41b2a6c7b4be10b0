"""One query per operator family of the engine, over the whole domain tables, with its SQL.

Searches take as queries every row whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.functions import bits as B
from lociframe.functions import cigar as C
from lociframe.functions import intervals as I
from lociframe.functions import seq as S
from lociframe.operators import mining as M
from lociframe.operators import overlap as O
from lociframe.operators import textindex as X
from lociframe.operators.mapper import align_to_reference, best_local_hits, candidate_windows, exact_places, map_reads, quick_scan, to_records, trim_adapter
from lociframe.session import read_table
from lociframe.sources import formats as R

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_READS = "(select read_id, regexp_replace(translate(regexp_replace(seq, '\\s+', '', 'g'), 'acgtuU', 'ACGTTT'), '[^ACGT]', 'N', 'g') as s from fastq_read)"
_CONTIGS = "(select seq_id, name, description, regexp_replace(translate(regexp_replace(seq, '\\s+', '', 'g'), 'acgtuU', 'ACGTTT'), '[^ACGT]', 'N', 'g') as s from fasta_read)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _reads(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "fastq_read").select("read_id", "name", S.normalized(F.col("seq")).alias("s"), "qual", "run_name")


def _contigs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "fasta_read").select("seq_id", "name", "description", S.normalized(F.col("seq")).alias("s"), "file_name")


def _columns(name: str, frame, key: str, table: str, **pairs: tuple[Callable[[], Column], str]) -> None:
    """A projection query: output name to (column, SQL); columns are made when the query is."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return frame(spark, sf).select(key, *[column().alias(k) for k, (column, _) in pairs.items()])

    run.__name__ = name
    query(f"select {key}, {', '.join(f'{q} as {k}' for k, (_, q) in pairs.items())} from {table}")(run)


class _Names:
    def __getattr__(self, name: str) -> Column:
        return F.col(name)


c = _Names()
_chars = "case when s = '' then [] else string_split(s, '') end"
_columns("str_normalize", _reads, "read_id", _READS, s=(lambda: c.s, "s"))
_columns(
    "str_reverse_complement", _reads, "read_id", _READS,
    reversed=(lambda: S.reverse(c.s), "reverse(s)"), complement=(lambda: S.complement(c.s), "translate(s, 'ACGT', 'TGCA')"), reverse_complement=(lambda: S.reverse_complement(c.s), "reverse(translate(s, 'ACGT', 'TGCA'))"),
)
_columns(
    "str_slice_edit", _reads, "read_id", _READS,
    piece=(lambda: S.slice_of(c.s, 5, 25), "s[6:25]"), edited=(lambda: S.replace_base(c.s, 3, "N"), "s[1:3] || 'N' || s[5:]"), rotated=(lambda: S.rotated_left(c.s, 7), "s[8:] || s[1:7]"), no_n=(lambda: S.n_as_a(c.s), "translate(s, 'N', 'A')"), longer=(lambda: S.appended(c.s, F.lit("ACGT")), "s || 'ACGT'"),
)
_columns(
    "str_codes", _reads, "read_id", _READS,
    codes=(lambda: F.array_join(F.transform(S.base_codes(c.s), lambda x: x.cast("string")), ""), "translate(s, 'ACGTN', '01234')"), back=(lambda: S.from_codes(S.base_codes(c.s)), "s"),
)
_columns(
    "agg_base_counts", _reads, "read_id", _READS,
    counts=(lambda: F.array_join(F.transform(S.base_counts(c.s, "ACGTN"), lambda x: x.cast("string")), ","), "concat_ws(',', " + ", ".join(f"length(s) - length(replace(s, '{b}', ''))" for b in "ACGTN") + ")"),
    n_a=(lambda: S.base_count(F.substring(c.s, 11, 20), "A"), "length(s[11:30]) - length(replace(s[11:30], 'A', ''))"),
)
_columns(
    "str_pattern_positions", _reads, "read_id", _READS,
    places=(lambda: F.array_join(F.transform(S.positions_of(c.s, "TAT"), lambda x: x.cast("string")), ","), "array_to_string(list_filter(range(0, greatest(length(s) - 2, 0)), lambda i: s[i + 1 : i + 3] = 'TAT'), ',')"),
)
_columns(
    "str_iupac", _reads, "read_id", _READS,
    complement=(lambda: S.iupac_complement(F.translate(c.s, "N", "R")), "translate(translate(s, 'N', 'R'), 'ACGTR', 'TGCAY')"),
    reversed=(lambda: S.iupac_reverse(F.concat(c.s, F.lit("$"))), "reverse(s) || '$'"), plain=(lambda: S.iupac_to_acgt(F.translate(c.s, "A", "R")), "replace(s, 'A', 'N')"),
    code=(lambda: S.iupac_code(F.substring(c.s, 1, 2)), """case when contains(s[1:2], 'N') and s[1:2] = 'NN' then null else (['A','C','M','G','R','S','V','T','W','Y','H','K','D','B','N'])[
      (contains(s[1:2], 'A'))::int + 2 * (contains(s[1:2], 'C'))::int + 4 * (contains(s[1:2], 'G'))::int + 8 * (contains(s[1:2], 'T'))::int] end"""),
    bases=(lambda: S.genotype_of(S.iupac_code(F.substring(c.s, 1, 2))), """case when s[1:2] = 'NN' then null else (case when contains(s[1:2], 'A') then 'A' else '' end) || (case when contains(s[1:2], 'C') then 'C' else '' end)
      || (case when contains(s[1:2], 'G') then 'G' else '' end) || (case when contains(s[1:2], 'T') then 'T' else '' end) end"""),
    meets=(lambda: S.bases_match(F.substring(c.s, 1, 1), F.substring(c.s, 2, 1)), "s[1] = s[2] or s[1] = 'N' or s[2] = 'N'"),
)
_color = "case when {0}[{1}] = 'N' or {0}[{1} + 1] = 'N' then '.' else xor(instr('ACGT', {0}[{1}]) - 1, instr('ACGT', {0}[{1} + 1]) - 1)::varchar end"
_columns(
    "str_colors", _reads, "read_id", _READS,
    colors=(lambda: S.color_encode(c.s), f"array_to_string(list_transform(range(1, length(s) + 1), lambda i: {_color.format(chr(40) + chr(39) + 'T' + chr(39) + ' || s' + chr(41), 'i')}), '')"),
    decoded=(lambda: S.color_decode(S.color_encode(c.s)), "case when contains(s, 'N') then s[1 : instr(s, 'N') - 1] || repeat('N', length(s) - instr(s, 'N') + 1) else s end"),
)
_columns("read_limits", _reads, "read_id", _READS, k_share=(lambda: S.max_edit_distance(0.1, F.length(c.s)), "floor(length(s) * 0.1)::int"), k_fixed=(lambda: S.max_edit_distance(2, F.length(c.s)), "2"), too_many_n=(lambda: S.base_count(c.s, "N") > 2, "length(s) - length(replace(s, 'N', '')) > 2"))
_columns(
    "src_fasta_names", _contigs, "seq_id", _CONTIGS,
    short=(lambda: S.fasta_name(F.concat(F.lit("> "), "name", F.lit("|"), F.coalesce("description", F.lit("")))), "name"),
    text=(lambda: S.wrapped(c.s), "array_to_string(list_transform(range(0, (length(s) + 49) // 50), lambda i: s[i * 50 + 1 : i * 50 + 50]), chr(10))"),
)


@query(f"select '@' || name || chr(10) || s || chr(10) || '+' || chr(10) || coalesce(qual, repeat('!', length(s))) as value from {_READS.replace('read_id, ', 'read_id, name, qual, ')}")
def src_fastq_text(spark, sf):
    return R.fastq_text(_reads(spark, sf).select("name", F.col("s").alias("seq"), "qual"))



def _mask() -> Column:
    return F.col("read_id").cast("bigint") * 2654435761


_columns(
    "bit_vectors", _reads, "read_id", _READS,
    ones=(lambda: B.one_bits(_mask(), 3, 40).cast("bigint"), "bit_count((read_id * 2654435761) >> 3 & ((1::bigint << 37) - 1))::bigint"), rank=(lambda: B.rank_one(_mask(), F.lit(20)).cast("bigint"), "bit_count((read_id * 2654435761) & ((1::bigint << 20) - 1))::bigint"),
    with_bit=(lambda: B.set_bit(_mask(), F.lit(5)), "(read_id * 2654435761) | 32"), without=(lambda: B.clear_bit(_mask(), F.lit(4)), "(read_id * 2654435761) & ~16::bigint"), parsed=(lambda: B.parse_bits(F.lit("0110001")), "70::bigint"),
    third=(lambda: B.select_one(_mask(), F.lit(2)), "list_filter(range(0, 63), lambda i: ((read_id * 2654435761) >> i) & 1 = 1)[3]::int"),
    moved=(lambda: B.shifted(_mask(), -7), "(read_id * 2654435761) >> 7"), either=(lambda: _mask().bitwiseXOR(F.lit(1023).cast("bigint")), "xor(read_id * 2654435761, 1023::bigint)"),
    total=(lambda: B.sum_of(_mask(), F.lit(2**40 - 1)), "read_id * 2654435761 + 1099511627775"), spaced=(lambda: B.interleaved(F.col("read_id")), "list_sum(list_transform(range(0, 31), lambda i: ((read_id >> i) & 1) * (1::bigint << (2 * i))))::bigint"),
)


def _intervals(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "ginterval").filter("start_pos <= end_pos")


_G = "(select * from ginterval where start_pos <= end_pos)"


def _lo() -> Column:
    return F.lit(5_000_000)


def _hi() -> Column:
    return F.lit(9_000_000)


_columns(
    "prd_interval_predicates", _intervals, "interval_id", _G,
    strand=(lambda: I.strand_of(c.strand), "case when strand = '+' then '+' when strand is not null then '-' end"), length=(lambda: c.end_pos - c.start_pos, "end_pos - start_pos"),
    strict=(lambda: I.overlaps(c.start_pos, c.end_pos, _lo(), _hi()), "start_pos < 9000000 and 5000000 < end_pos"), touching=(lambda: I.overlaps(c.start_pos, c.end_pos, _lo(), _hi(), "touching"), "start_pos <= 9000000 and 5000000 <= end_pos"), lopsided=(lambda: I.overlaps(c.start_pos, c.end_pos, _lo(), _hi(), "asymmetric"), "start_pos < 9000000 and 5000000 <= end_pos"),
    inside=(lambda: I.contains(_lo(), _hi(), c.start_pos, c.end_pos), "5000000 <= start_pos and end_pos <= 9000000"), holds=(lambda: I.contains_position(c.start_pos, c.end_pos, F.lit(6_000_000)), "start_pos <= 6000000 and 6000000 < end_pos"),
    from_pos=(lambda: I.intersection(c.start_pos, c.end_pos, _lo(), _hi())["start"], "case when greatest(start_pos, 5000000) <= least(end_pos, 9000000) then greatest(start_pos, 5000000) end"),
    to_pos=(lambda: I.intersection(c.start_pos, c.end_pos, _lo(), _hi())["end"], "case when greatest(start_pos, 5000000) <= least(end_pos, 9000000) then least(end_pos, 9000000) end"),
)
_columns(
    "prd_strand_ranges", _intervals, "interval_id", _G,
    five=(lambda: I.five_prime(c.start_pos, c.end_pos, c.strand), "case when strand = '+' then start_pos else end_pos end"), three=(lambda: I.three_prime(c.start_pos, c.end_pos, c.strand), "case when strand = '+' then end_pos else start_pos end"),
    around_start=(lambda: I.around(c.start_pos, c.strand, 100, 20)["start"], "start_pos - case when strand = '+' then 100 else 20 end"), around_end=(lambda: I.around(c.start_pos, c.strand, 100, 20)["end"], "start_pos + case when strand = '+' then 20 else 100 end"),
    up=(lambda: I.upstream(c.start_pos, c.strand, 50)["start"], "case when strand = '+' then start_pos - 50 else start_pos end"), down=(lambda: I.downstream(c.start_pos, c.strand, 50)["end"], "case when strand = '+' then start_pos + 50 else start_pos end"), moved=(lambda: I.move(c.start_pos, c.strand, 7), "case when strand = '+' then start_pos + 7 else start_pos - 7 end"),
)


def _region() -> Column:
    return I.region(F.concat("chr", F.lit(":1,"), F.lpad(F.pmod(c.start_pos, F.lit(1000)).cast("string"), 3, "0")))


_columns("prd_region_expression", _intervals, "interval_id", _G, chr=(lambda: _region()["chr"], "chr"), start=(lambda: _region()["start"], "case when chr is null or start_pos is null then 0 else 1000 + ((start_pos % 1000) + 1000) % 1000 end"), whole=(lambda: I.region(F.lit("lg1"))["end"], "0"))


def _genes(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals as genes of three blocks."""
    g = _intervals(spark, sf).filter("end_pos - start_pos >= 9").withColumn("w", F.expr("(end_pos - start_pos) div 9"))
    blocks = I.exons(F.col("start_pos"), F.expr("array(w, w, w)"), F.expr("array(0, 3 * w, 6 * w)"))
    return g.withColumn("exons", blocks).withColumns({"cds": I.clipped_to(F.col("exons"), F.expr("start_pos + w div 2"), F.expr("start_pos + 6 * w")), "introns": I.gaps_between(F.col("exons"))})


_text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
_genes_sql = "(select *, (end_pos - start_pos) // 9 as w from ginterval where start_pos <= end_pos and end_pos - start_pos >= 9)"
_columns(
    "prd_gene_structure", _genes, "interval_id", _genes_sql,
    exon_list=(lambda: _text(F.col("exons")), "start_pos || '-' || (start_pos + w) || ',' || (start_pos + 3 * w) || '-' || (start_pos + 4 * w) || ',' || (start_pos + 6 * w) || '-' || (start_pos + 7 * w)"),
    coding=(lambda: _text(F.col("cds")), "case when w > w // 2 then (start_pos + w // 2) || '-' || (start_pos + w) || ',' else '' end || (start_pos + 3 * w) || '-' || (start_pos + 4 * w)"),
    intron_list=(lambda: _text(F.col("introns")), "(start_pos + w) || '-' || (start_pos + 3 * w) || ',' || (start_pos + 4 * w) || '-' || (start_pos + 6 * w)"),
    cds_start=(lambda: I.span_of(F.col("cds"))["start"], "case when w > w // 2 then start_pos + w // 2 else start_pos + 3 * w end"), cds_end=(lambda: I.span_of(F.col("cds"))["end"], "start_pos + 4 * w"),
    cds_five=(lambda: I.five_prime(I.span_of(F.col("cds"))["start"], I.span_of(F.col("cds"))["end"], c.strand), "case when strand = '+' then case when w > w // 2 then start_pos + w // 2 else start_pos + 3 * w end else start_pos + 4 * w end"),
    first_exon=(lambda: I.first_block(F.col("exons"), c.strand)["start"], "case when strand = '+' then start_pos else start_pos + 6 * w end"), last_exon=(lambda: I.last_block(F.col("exons"), c.strand)["start"], "case when strand = '+' then start_pos + 6 * w else start_pos end"),
)


def _bed() -> Column:
    return R.parse_bed4(F.concat_ws("\t", "chr", (c.start_pos - 1).cast("string"), (c.end_pos - 1).cast("string"), c.strand))


_whole = "(select * from ginterval where start_pos <= end_pos and chr is not null and strand is not null)"


def _complete(spark: SparkSession, sf: str) -> DataFrame:
    return _intervals(spark, sf).filter("chr is not null and strand is not null")


_columns("src_bed_lines", _complete, "interval_id", _whole, chr=(lambda: _bed()["chr"], "chr"), start=(lambda: _bed()["start"], "start_pos"), end=(lambda: _bed()["end"], "end_pos"), strand=(lambda: _bed()["strand"], "case when strand = '+' then '+' else '-' end"))


@query(f"""select interval_id, chr || chr(9) || (start_pos - 1) || chr(9) || (end_pos - 1) || chr(9) || 'x' || chr(9) || '0' || chr(9) || case when strand = '+' then '+' else '-' end || chr(9) || (start_pos - 1) || chr(9) || (end_pos - 1) || chr(9) || '0' || chr(9) || '2' || chr(9) || '1,2,' || chr(9) || '0,5,' as line from {_whole}""")
def src_bed12_round_trip(spark, sf):
    line = F.concat_ws("\t", "chr", (c.start_pos - 1).cast("string"), (c.end_pos - 1).cast("string"), F.lit("x"), F.lit("0"), "strand", (c.start_pos - 1).cast("string"), (c.end_pos - 1).cast("string"), F.lit("0"), F.lit("2"), F.lit("1,2"), F.lit("0,5"))
    parsed = _complete(spark, sf).select("interval_id", R.parse_bed12(line).alias("b")).select("interval_id", "b.*")
    text = R.bed12_text(parsed.withColumn("name", F.concat("name", F.lit("\t#"), F.col("interval_id").cast("string"))))
    return text.select(F.regexp_extract("value", r"\t#(\d+)", 1).cast("bigint").alias("interval_id"), F.regexp_replace("value", r"\t#\d+", "").alias("line"))


_ALN = "alignment"


def _alignments(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "alignment")


def _cigar() -> Column:
    return F.coalesce("cigar", F.lit(""))


_parts = "list_transform(regexp_extract_all(coalesce(cigar, ''), '[0-9]+[MIDNSHPX=]'), lambda x: x)"
_joined_runs = f"""(select * from alignment join (
    with u as (select aln_id, generate_subscripts(l, 1) as i, unnest(l) as x from (select aln_id, list_concat(['12S', '2S'], {_parts}, ['62M']) as l from alignment)),
      o as (select aln_id, i, x[-1] as op, x[:-2]::int as n, case when x[-1] = lag(x[-1]) over (partition by aln_id order by i) then 0 else 1 end as opens from u),
      g as (select aln_id, op, n, sum(opens) over (partition by aln_id order by i rows unbounded preceding) as g from o),
      m as (select aln_id, g, op, sum(n)::int as n from g group by aln_id, g, op)
    select aln_id, string_agg(n || op, '' order by g) as joined from m group by aln_id) using (aln_id))"""
_columns(
    "str_cigar", _alignments, "aln_id", _joined_runs,
    rendered=(lambda: C.render_cigar(C.parse_cigar(_cigar())), f"array_to_string({_parts}, '')"), n_ops=(lambda: F.size(C.parse_cigar(_cigar())), f"len({_parts})"),
    unclipped=(lambda: C.unclipped_size(_cigar()), f"coalesce(list_sum(list_transform(list_filter({_parts}, lambda x: x[-1] <> 'I'), lambda x: x[:-2]::int)), 0)::int"),
    joined=(lambda: C.append_cigar(F.lit("12S"), F.concat(F.lit("2S"), _cigar(), F.lit("62M"))), "joined"),
)
_columns(
    "hit_scores", _alignments, "aln_id", _ALN,
    score=(lambda: C.hit_score(F.col("end_pos") - F.col("start_pos"), F.col("num_mismatches"), F.when(F.col("split").isNull(), 0).otherwise(1)), "(end_pos::bigint - start_pos)::int - num_mismatches * 3 - case when split is null then 0 else 11 end"),
    state=(lambda: C.alignment_state(F.col("num_best_hits")), "case when num_best_hits = 1 then 'U' when num_best_hits > 1 then 'R' else 'N' end"),
)


@query("""select aln_id, coalesce(read_name, '*') || chr(9) || ((case when split is not null then 1 else 0 end) + (case when coalesce(num_best_hits, 0) > 0 then 2 else 4 end) + (case when split is not null and coalesce(num_best_hits, 0) <= 0 then 8 else 0 end) + (case when strand = '-' then 16 else 0 end) + 64)
  || chr(9) || coalesce(chr, '*') || chr(9) || coalesce(start_pos, 0) || chr(9) || coalesce(score, 0) || chr(9) || coalesce(cigar, '*')
  || chr(9) || case when split is null then '*' when split.chr = chr and chr <> '*' then '=' else coalesce(split.chr, '*') end || chr(9) || case when split is null then 0 else coalesce(split.start_pos, 0) end || chr(9) || case when split is null then 0 else coalesce(split.end_pos::bigint - start_pos, 0) end
  || chr(9) || coalesce(query_seq, '*') || chr(9) || coalesce(qual, '*') || case when coalesce(num_best_hits, 0) > 0 then coalesce(chr(9) || 'NM:i:' || case when num_mismatches >= 0 then num_mismatches end, '') || coalesce(chr(9) || 'XP:Z:' || alignment_state, '') || chr(9) || 'X0:i:' || num_best_hits else '' end as line from alignment""")
def src_sam_lines(spark, sf):
    columns = ("read_name", "chr", "strand", "start_pos", "end_pos", "num_mismatches", "cigar", "query_seq", "qual", "score", "num_best_hits", "alignment_state", "split")
    return _alignments(spark, sf).select("aln_id", C.sam_line({c: F.col(c) for c in columns}).alias("line"))


_Q = "(select * from alignment where aln_id % 50 = 0 and start_pos < end_pos and start_pos >= 1 and chr is not null)"
_D = "(select * from alignment where start_pos < end_pos and start_pos >= 1 and chr is not null)"


def _search(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    q = read_table(spark, sf, "alignment").filter("aln_id % 50 = 0 and start_pos < end_pos and start_pos >= 1").select("aln_id", "chr", "start_pos", "end_pos", "strand")
    d = read_table(spark, sf, "alignment").filter("start_pos < end_pos and start_pos >= 1").select("aln_id", "chr", "start_pos", "end_pos", "strand")
    return q, d


@query(f"select q.aln_id as q_id, d.aln_id as d_id from {_Q} q join {_D} d on q.chr = d.chr and q.start_pos < d.end_pos and d.start_pos < q.end_pos")
def join_overlap(spark, sf):
    return O.overlap_join(*_search(spark, sf)).select(F.col("q.aln_id").alias("q_id"), F.col("d.aln_id").alias("d_id"))


@query(f"select q.aln_id as q_id, d.aln_id as d_id from {_Q} q join {_D} d on q.chr = d.chr and q.strand = d.strand and q.start_pos <= d.end_pos and d.start_pos <= q.end_pos")
def join_overlap_touching_stranded(spark, sf):
    return O.overlap_join(*_search(spark, sf), mode="touching").filter("q.strand = d.strand").select(F.col("q.aln_id").alias("q_id"), F.col("d.aln_id").alias("d_id"))


@query(f"select aln_id from {_Q} q where exists (select 1 from {_D} d where q.chr = d.chr and q.start_pos < d.end_pos and d.start_pos < q.end_pos)")
def join_any_overlap(spark, sf):
    return O.any_overlap(*_search(spark, sf), id_col="aln_id").select("aln_id")


@query("select interval_id from ginterval where end_pos between 1000000 and 6000000 and start_pos <= 5500000")
def join_three_sided_range(spark, sf):
    return read_table(spark, sf, "ginterval").filter(F.col("end_pos").between(1_000_000, 6_000_000) & (F.col("start_pos") <= 5_500_000)).select("interval_id")


@query("""with g as (select interval_id, chr, strand, start_pos, end_pos from ginterval where start_pos <= end_pos and chr is not null and strand is not null)
    select q.interval_id as q_id, d.interval_id as d_id, abs(d.start_pos - q.start_pos) as distance from g q join g d on q.chr = d.chr and q.strand = d.strand and q.interval_id <> d.interval_id and q.start_pos <> d.start_pos
      and d.start_pos < q.start_pos + 20000 and d.end_pos > q.start_pos - 20000 and (d.start_pos < d.end_pos or (d.start_pos < q.start_pos + 20000 and d.start_pos > q.start_pos - 20000))
    where q.interval_id % 50 = 0 qualify row_number() over (partition by q.interval_id order by abs(d.start_pos - q.start_pos), d.interval_id) = 1""")
def join_nearest(spark, sf):
    g = _intervals(spark, sf).select("interval_id", "chr", "strand", "start_pos", "end_pos").filter("strand is not null")
    return O.nearest_neighbour(g.filter("interval_id % 50 = 0"), g, 20_000, "interval_id", "interval_id")


@query("""with o as (select chr, n_bases, sum(n_bases) over (order by chr rows unbounded preceding) - n_bases as off from chrom_size)
    select interval_id, coalesce(off + start_pos - 1, -1)::bigint as text_index from ginterval g left join o on g.chr = o.chr where start_pos is not null""")
def join_locus_to_text(spark, sf):
    offsets = O.concat_offsets(read_table(spark, sf, "chrom_size").select("chr", "n_bases"), "chr", "n_bases")
    loci = read_table(spark, sf, "ginterval").filter("start_pos is not null").select("interval_id", "chr", F.col("start_pos").alias("pos"))
    return O.to_text_index(loci, offsets).select("interval_id", F.col("text_index").cast("bigint").alias("text_index"))


@query("""with o as (select chr, n_bases, sum(n_bases) over (order by chr rows unbounded preceding) - n_bases as off from chrom_size), i as (select aln_id, (abs(start_pos::bigint) * 5 + 1)::bigint as text_index from alignment where start_pos is not null)
    select aln_id, text_index, o.chr, (text_index - off)::bigint as pos from i join o on off < text_index and text_index <= off + n_bases""")
def join_text_to_locus(spark, sf):
    offsets = O.concat_offsets(read_table(spark, sf, "chrom_size").select("chr", "n_bases"), "chr", "n_bases")
    indexes = read_table(spark, sf, "alignment").filter("start_pos is not null").select("aln_id", (F.abs(F.col("start_pos").cast("bigint")) * 5 + 1).alias("text_index"))
    return O.to_locus(indexes, offsets).select("aln_id", "text_index", "chr", F.col("pos").cast("bigint").alias("pos"))


_DENSE = """(select g.chr, p as pos, arg_max(struct_pack(v := score), interval_id).v as score from (select *, unnest(range(start_pos, end_pos)) as p from ginterval where start_pos < end_pos and chr is not null) g group by g.chr, p)"""


@query(f"select chr, floor(pos / 65536)::bigint as block, count(*) as positions, min(score)::double as low, max(score)::double as high from {_DENSE} group by all")
def agg_dense_scores(spark, sf):
    g = read_table(spark, sf, "ginterval")
    return O.dense_runs(g, "interval_id").groupBy("chr", F.expr("cast(floor(start_pos / 65536) as bigint)").alias("block")).agg(F.sum(F.expr("end_pos - start_pos")).alias("positions"), F.min("score").cast("double").alias("low"), F.max("score").cast("double").alias("high"))


@query(f"select aln_id, a.chr, a.start_pos as pos, coalesce(d.score, 0)::double as score from (select * from alignment where start_pos is not null and chr is not null) a left join {_DENSE} d on a.chr = d.chr and a.start_pos = d.pos")
def join_score_lookup(spark, sf):
    loci = read_table(spark, sf, "alignment").filter("start_pos is not null and chr is not null").select("aln_id", "chr", F.col("start_pos").alias("pos"))
    return O.score_at(loci, O.dense_runs(read_table(spark, sf, "ginterval"), "interval_id")).withColumn("score", F.col("score").cast("double"))


@query("""with b as (select chr, score, unnest(range(floor(start_pos / 100000)::bigint, floor((end_pos - 1) / 100000)::bigint + 1)) as bin from ginterval where start_pos < end_pos and chr is not null)
    select chr, bin * 100000 as bin_start, (bin + 1) * 100000 as bin_end, count(*) as members, min(score)::double as low, max(score)::double as high from b group by all""")
def agg_bins(spark, sf):
    return O.bin_statistics(read_table(spark, sf, "ginterval"), 100_000).withColumns({"low": F.col("low").cast("double"), "high": F.col("high").cast("double")})


@query("""with b as (select chr, interval_id, unnest(range(floor(start_pos / 1000000)::bigint, floor((end_pos - 1) / 1000000)::bigint + 1)) as bin from ginterval where start_pos < end_pos and chr is not null)
    select chr, bin * 1000000 as bin_start, interval_id from b""")
def agg_bin_members(spark, sf):
    return O.bin_members(read_table(spark, sf, "ginterval"), 1_000_000, "interval_id").select("chr", "bin_start", F.explode("members").alias("interval_id"))


@query("""with g as (select interval_id as id, chr, start_pos as s, end_pos as e from ginterval where start_pos <= end_pos and chr is not null)
    select q.id, count(*) as n_active, array_to_string(list_sort(list(d.id)), ',') as active from g q join g d on q.chr = d.chr and (d.s, d.e, d.id) <= (q.s, q.e, q.id) and d.e >= q.s where q.id % 50 = 0 group by q.id having count(*) > 1""")
def win_overlap_sweep(spark, sf):
    g = _intervals(spark, sf)
    return O.sweep_active(g.filter("interval_id % 50 = 0"), g, "interval_id").withColumn("active", F.array_join(F.transform("active", lambda x: x.cast("string")), ","))


@query(f"select seq_id, name, length(s) as length, (sum(length(s)) over (order by seq_id) - length(s))::bigint as offset_at from {_CONTIGS}".replace("offset_at", '"offset"'))
def win_concat_offsets(spark, sf):
    sized = _contigs(spark, sf).select("seq_id", "name", F.length("s").alias("length"))
    return O.concat_offsets(sized, "seq_id", "length").withColumn("offset", F.col("offset").cast("bigint"))


@query(f"""select r.seq_id, s[r.seq_id % 97 + 1 : r.seq_id % 97 + 60] as piece from fasta_read r join {_CONTIGS} c on r.name = c.name""")
def src_sub_sequence(spark, sf):
    requests = read_table(spark, sf, "fasta_read").select("seq_id", "name", F.expr("cast(seq_id % 97 as int)").alias("start"), F.expr("cast(seq_id % 97 + 60 as int)").alias("end"))
    return R.sub_sequences(_contigs(spark, sf), requests, seq="s").select("seq_id", "piece")


@query("select block, count(*) as reads, min(read_id) as first_id from (select read_id, (row_number() over (order by read_id) - 1) // 1024 as block from fastq_read) group by block")
def win_read_blocks(spark, sf):
    n = O.concat_offsets(read_table(spark, sf, "fastq_read").select("read_id", F.lit(1).alias("one")), "read_id", "one")
    return n.groupBy(F.expr("offset div 1024").alias("block")).agg(F.count(F.lit(1)).alias("reads"), F.min("read_id").alias("first_id"))


@query("select chr, row_number() over (order by regexp_replace(chr, '[0-9]+', ''), case when regexp_matches(chr, '[0-9]') then regexp_extract(chr, '([0-9]+)', 1)::int else -1 end) as place from chrom_size")
def ord_natural(spark, sf):
    from pyspark.sql import Window

    ranked = O.natural_order(read_table(spark, sf, "chrom_size").select("chr"), "chr")  # chrom_size is fixed, 421 rows
    return ranked.select("chr", F.row_number().over(Window.orderBy("rank_key")).alias("place"))


@query("select interval_id, chr, start_pos, end_pos from ginterval where start_pos <= end_pos order by chr, start_pos, end_pos, interval_id")
def ord_intervals(spark, sf):
    return _intervals(spark, sf).select("interval_id", "chr", "start_pos", "end_pos").orderBy("chr", "start_pos", "end_pos", "interval_id")


@query("""select read_id, aln_id, hit_rank from (select *, row_number() over (partition by read_id order by coalesce(score, -1000) desc, coalesce(chr, ''), coalesce(start_pos, 0), coalesce(strand, ''), aln_id) as hit_rank from alignment) where hit_rank <= 5""")
def ord_top_hits(spark, sf):
    hits = _alignments(spark, sf).select("read_id", "aln_id", F.coalesce("score", F.lit(-1000)).alias("score"), F.coalesce("chr", F.lit("")).alias("chr"), F.coalesce("start_pos", F.lit(0)).alias("start_pos"), F.struct(F.coalesce("strand", F.lit("")), "aln_id").alias("strand"))
    return O.top_hits(hits, "read_id", F.col("score")).select("read_id", "aln_id", "hit_rank")


@query("select read_id, count(*) as hits, bool_and(num_best_hits = 1) as all_unique, min(num_mismatches) as least, max(end_pos::bigint - start_pos)::bigint as longest from alignment where start_pos >= 1 and start_pos < end_pos group by read_id")
def agg_hit_statistics(spark, sf):
    h = _alignments(spark, sf).filter("start_pos >= 1 and start_pos < end_pos")
    return h.groupBy("read_id").agg(F.count(F.lit(1)).alias("hits"), F.bool_and(F.col("num_best_hits") == 1).alias("all_unique"), F.min("num_mismatches").alias("least"), F.max(F.col("end_pos").cast("bigint") - F.col("start_pos")).alias("longest"))


@query("select distinct read_id, strand, start_pos from alignment")
def set_candidate_starts(spark, sf):
    return _alignments(spark, sf).select("read_id", "strand", "start_pos").distinct()


@query("select name from fastq_read group by name having count(*) = 1")
def set_unrepeated(spark, sf):
    return read_table(spark, sf, "fastq_read").groupBy("name").count().filter("count = 1").select("name")


_FLAGS = ["case when contains(s, 'A') then 1 else 0 end", "case when contains(s, 'C') then 2 else 0 end", "case when contains(s, 'G') then 4 else 0 end", "case when contains(s, 'T') then 8 else 0 end", "case when contains(s, 'N') then 15 else 0 end"]


@query(f"select run_name, bit_or({' | '.join(f'({x})' for x in _FLAGS)}) as bases from {_READS.replace('read_id, ', 'read_id, run_name, ')} group by run_name")
def set_base_flags(spark, sf):
    """Bases that the reads of a run hold, N standing for all."""
    return _reads(spark, sf).groupBy("run_name").agg(F.bit_or(F.expr(" | ".join(f"({x})" for x in _FLAGS))).alias("bases"))


@query(f"select letter, n, (sum(n) over (order by letter) - n)::bigint as smaller from (select unnest(string_split(s, '')) as letter, count(*) as n from {_READS} where s <> '' group by 1)")
def agg_smaller_counts(spark, sf):
    letters = _reads(spark, sf).select(F.explode(F.filter(F.split("s", ""), lambda c: c != "")).alias("letter"))
    return X.smaller_counts(letters).withColumn("smaller", F.col("smaller").cast("bigint"))


_SA = f"""(select read_id, t, row_number() over (partition by read_id order by substr(t, p + 1)) - 1 as i, p as pos, substr(t, case when p = 0 then length(t) else p end, 1) as bwt from (select read_id, s || '$' as t, unnest(range(0, length(s) + 1)) as p from {_READS}))"""


@query(f"select read_id, i, pos, bwt from {_SA}")
def idx_suffix_arrays(spark, sf):
    return X.suffix_arrays(_reads(spark, sf), "read_id", "s")


@query(f"select read_id, bwt as letter, i // 16 as block, count(*) as n from {_SA} group by all")
def idx_bwt_blocks(spark, sf):
    return X.suffix_arrays(_reads(spark, sf), "read_id", "s").groupBy("read_id", F.col("bwt").alias("letter"), F.expr("i div 16").alias("block")).agg(F.count(F.lit(1)).alias("n"))


def _joined_text(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """One text out of all contigs, as rows of letters."""
    return X.joined_letters(_contigs(spark, sf), "seq_id", "s")


_WHOLE_TEXT = """(select case when length(t) % 2 = 0 then t || 'N' else t end as t from (select string_agg(u, '' order by seq_id) as t from
    (select seq_id, regexp_replace(translate(regexp_replace(seq, '\\s+', '', 'g'), 'acgturymkwsbvdhnU', 'ACGTTRYMKWSBVDHNT'), '[^ACGTRYMKWSBVDHN]', 'N', 'g') as u from fasta_read)))"""


@query(f"""select b as block, substr(t || '$', b * 4096 + 1, 4096) as forward, substr(reverse(t) || '$', b * 4096 + 1, 4096) as backward from (select t, unnest(range(0, length(t) // 4096 + 1)) as b from {_WHOLE_TEXT})""")
def src_iupac_text(spark, sf):
    """The text of all contigs in IUPAC codes, padded and closed, in blocks, and the same of the reversed text."""
    coded = read_table(spark, sf, "fasta_read").select("seq_id", S.iupac_normalized(F.col("seq")).alias("s"))

    def blocks(backwards: bool, name: str) -> DataFrame:
        letters, _ = X.joined_letters(coded, "seq_id", "s", even=True, backwards=backwards)
        rows = letters.select(F.expr("pos div 4096").alias("block"), F.struct("pos", F.when(F.col("letter") == 0, "$").otherwise(F.char("letter")).alias("c")).alias("x"))
        return rows.groupBy("block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"]), "").alias(name))  # 4096 letters

    return blocks(False, "forward").join(blocks(True, "backward"), "block")


@query()
def idx_distributed_suffix_array(spark, sf):
    letters, n = _joined_text(spark, sf)
    return X.distributed_suffix_array(letters, n).select("i", "pos")


@query()
def idx_occurrence_table(spark, sf):
    letters, n = _joined_text(spark, sf)
    bwt = X.burrows_wheeler(X.distributed_suffix_array(letters, n), letters, n)
    return X.occurrence_table(bwt, 128).withColumn("occ", F.col("occ").cast("bigint"))


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    """A base in every 13 letters of each contig, from a place by the id on."""
    return _contigs(spark, sf).filter("length(s) >= 1 + seq_id % 7").select(F.col("name").alias("chr"), F.explode(F.expr("sequence(cast(1 + seq_id % 7 as int), length(s), 13)")).alias("pos"), F.lit("N").alias("alt"))


@query(f"""with v as (select name, list(distinct struct_pack(r := seq_id % 7, n := length(s))) as v from {_CONTIGS} group by name)
    select seq_id, array_to_string(list_transform(range(1, length(s) + 1), lambda p: case when list_bool_or(list_transform(v, lambda x: p > x.r and p <= x.n and (p - 1 - x.r) % 13 = 0)) then 'N' else s[p] end), '') as consensus
    from {_CONTIGS} c join v using (name)""")
def min_consensus(spark, sf):
    return M.consensus(_contigs(spark, sf).select("seq_id", "name", "s"), _variants(spark, sf), "name", "s").select("seq_id", "consensus")


_VARIANTS = "(select *, query_seq[1 : 1 + aln_id % 2] as ref, query_seq[4 : 4 + aln_id % 3 // 2] as alt from alignment where query_seq is not null and chr is not null and start_pos is not null and end_pos is not null and length(query_seq) >= 8)"


def _variant_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Alignments written as variant lines and parsed again."""
    rows = _alignments(spark, sf).filter("query_seq is not null and chr is not null and start_pos is not null and end_pos is not null and length(query_seq) >= 8")
    text = lambda x: F.expr(x).cast("string")
    line = F.concat_ws("\t", text("aln_id"), "chr", text("start_pos"), text("end_pos"), text("substring(query_seq, 1, 1 + aln_id % 2)"), F.lit("rs"), text("substring(query_seq, 4, 1 + aln_id % 3 div 2)"), F.lit("2"), F.lit("(A,3)"), F.concat(F.lit("(C,"), text("aln_id % 10"), F.lit(")")))
    return rows.select(R.parse_variant(line).alias("v")).select("v.*")


@query(f"select aln_id, chr, start_pos, end_pos, ref, alt, 2 as alleles, 3 + aln_id % 10 as reads from {_VARIANTS}")
def src_variant_lines(spark, sf):
    v = _variant_rows(spark, sf)
    return v.select(F.col("id").cast("bigint").alias("aln_id"), "chr", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), F.col("ref_allele").alias("ref"), F.col("alt_allele").alias("alt"), F.size("freq").alias("alleles"), F.expr("aggregate(freq, 0L, (t, x) -> t + x.count)").alias("reads"))


@query(f"select aln_id from {_VARIANTS} where length(ref) = 1 and length(alt) = 1")
def prd_single_difference(spark, sf):
    return _variant_rows(spark, sf).filter(R.single_base(F.col("ref_allele"), F.col("alt_allele"))).select(F.col("id").cast("bigint").alias("aln_id"))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("point"))


@query("""select d::int as dim, round(avg(v), 6) as center, min(v) as low, max(v) as high, round(sum(v * v) / count(*) - avg(v) ** 2, 6) as squared_error
    from (select unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as d from embeddings) group by d""")
def agg_point_metrics(spark, sf):
    """Center of mass, bounds and mean squared error in every dimension."""
    p = _points(spark, sf).select(F.posexplode("point").alias("dim", "v"))
    return p.groupBy("dim").agg(F.round(F.avg("v"), 6).alias("center"), F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.avg(F.col("v") ** 2) - F.avg("v") ** 2, 6).alias("squared_error"))


@query("""with c as (select row_number() over (order by vec_id) - 1 as k, embedding as c from embeddings where vec_id in (select vec_id from embeddings order by vec_id limit 5)),
    d as (select vec_id, k, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::double - c[i]::double) ** 2)) as d from embeddings, c)
    select vec_id, k::int as cluster_id from d qualify row_number() over (partition by vec_id order by d, k) = 1""")
def min_nearest_centroid(spark, sf):
    """The assignment of one round of k-means, around the five points with the least ids."""
    points = _points(spark, sf)
    return M.assign(points, "point", [list(r[0]) for r in points.orderBy("vec_id").limit(5).select("point").collect()]).select("vec_id", "cluster_id")


@query()
def min_k_means(spark, sf):
    points = _points(spark, sf)
    return M.k_means(points, "point", M.initial_centroids(points, "point", "vec_id", 5))[0].select("vec_id", "cluster_id")


@query()
def min_x_means(spark, sf):
    return M.x_means(_points(spark, sf), "point", 8)[0].select("vec_id", "cluster_id")


def _one_per_name(spark: SparkSession, sf: str) -> DataFrame:
    """Of contigs with one name the one with the least id."""
    return _contigs(spark, sf).groupBy("name").agg(F.min_by("s", "seq_id").alias("s"))


@query()
def aln_map_reads(spark, sf):
    return map_reads(read_table(spark, sf, "fastq_read"), _one_per_name(spark, sf), k=2, seed=16, ref_seq="s")


@query()
def aln_map_reads_unique(spark, sf):
    return map_reads(read_table(spark, sf, "fastq_read"), _one_per_name(spark, sf), k=1, seed=20, unique_only=True, ref_seq="s")


@query()
def aln_align_to_text(spark, sf):
    return align_to_reference(_reads(spark, sf).filter("read_id % 50 = 0").select("read_id", "s"), _one_per_name(spark, sf))


@query()
def aln_smith_waterman(spark, sf):
    """Local alignments of whole reads with an id divisible by 50, in all contigs."""
    return best_local_hits(_reads(spark, sf).filter("read_id % 50 = 0"), _one_per_name(spark, sf), k=3, seed=14, read_seq="s", ref_seq="s")


_EXACT = f"""(select read_id, chr, strand, p + 1 as start_pos from (select read_id, f.name as chr, strand, f.s as t, q, unnest(range(0, length(f.s) - length(q) + 1)) as p
    from (select read_id, '+' as strand, s as q from {_READS} union all select read_id, '-', reverse(translate(s, 'ACGT', 'TGCA')) from {_READS}) r
    join (select name, arg_min(s, seq_id) as s from {_CONTIGS} group by name) f on contains(f.s, q) where q <> '' and not contains(q, 'N')) where substr(t, p + 1, length(q)) = q)"""


@query(f"select read_id, count(*)::int as places, min(chr) as first_chr, min(start_pos)::int as least_start from {_EXACT} group by read_id")
def aln_exact_hits(spark, sf):
    """All places in which whole reads without N stand exactly, over the candidates of the mapper."""
    w = candidate_windows(_reads(spark, sf).filter("not contains(s, 'N')"), _one_per_name(spark, sf), 0, 31, read_seq="s", ref_seq="s")
    return w.filter(F.col("window") == F.col("q")).groupBy("read_id").agg(F.count(F.lit(1)).cast("int").alias("places"), F.min("chr").alias("first_chr"), (F.min("from") + 1).alias("least_start"))


@query()
def idx_quick_scan(spark, sf):
    """Breaks and longest exact segments of whole reads with an id divisible by 50 in the longest contig."""
    text = _contigs(spark, sf).orderBy(F.length("s").desc(), "seq_id").select("s").first()[0]
    found = quick_scan(_reads(spark, sf).filter("read_id % 50 = 0").select("read_id", "s"), "s", text)
    return found.select("read_id", "scan.breaks", F.col("scan.start").alias("segment_start"), F.col("scan.end").alias("segment_end"), F.size("scan.hits").alias("places"))


@query()
def aln_split_sam(spark, sf):
    """SAM lines of the best placements of whole reads with an id divisible by 50, clipped and split ones included."""
    hits = align_to_reference(_reads(spark, sf).filter("read_id % 50 = 0").select("read_id", "s"), _one_per_name(spark, sf))
    rows = to_records(hits.filter("chr is not null").withColumns({"num_best_hits": F.lit(1), "alignment_state": F.lit("U")}), read_table(spark, sf, "fastq_read").filter("read_id % 50 = 0").hint("merge"))
    columns = ("read_name", "chr", "strand", "start_pos", "end_pos", "num_mismatches", "cigar", "query_seq", "qual", "score", "num_best_hits", "alignment_state", "split")
    return rows.select("read_id", C.sam_line({x: F.col(x) for x in columns}).alias("line"))


# Fixed value: the adapter that is cut from both mates.
ADAPTER = "CTGCTGTACCCTACATCCGCCTTGGCCGTACAGCAG"


@query(f"""select * from (select read_id, seq_1, seq_2, strpos(seq_1, '{ADAPTER}')::int - 1 as cut_1, strpos(seq_2, '{ADAPTER}')::int - 1 as cut_2
    from (select read_id, s || '{ADAPTER}' as seq_1, reverse(translate(s, 'ACGT', 'TGCA')) || '{ADAPTER}ACGT' as seq_2 from {_READS})) where cut_1 >= 20 and cut_2 >= 20""")
def min_adapter_trim(spark, sf):
    pairs = _reads(spark, sf).select("read_id", F.concat("s", F.lit(ADAPTER)).alias("seq_1"), F.concat(S.reverse_complement(F.col("s")), F.lit(ADAPTER), F.lit("ACGT")).alias("seq_2"))
    return trim_adapter(pairs, ADAPTER)


_RAW = "(select read_id, translate(regexp_replace(seq, '\\s+', '', 'g'), 'acgturymkwsbvdhnU', 'ACGTTRYMKWSBVDHNT') as u from fastq_read)"


@query(f"select read_id, regexp_replace(u, '[^ACGTRYMKWSBVDHN]', 'N', 'g') as codes, length(u) - length(replace(u, 'N', '')) as n_n from {_RAW}")
def src_iupac_encode(spark, sf):
    coded = S.iupac_normalized(F.col("seq"))
    return read_table(spark, sf, "fastq_read").select("read_id", coded.alias("codes"), S.base_count(coded, "N").alias("n_n"))


@query("""select aln_id, case when split is null or chr is null and split.chr is not null then null else split.chr end as x, case when split is null then chr when chr is null then split.chr when split.chr is null or chr < split.chr or (chr = split.chr and start_pos <= split.start_pos) then chr else split.chr end as first_chr from alignment where split is null or (start_pos is not null and split.start_pos is not null)""".replace("case when split is null or chr is null and split.chr is not null then null else split.chr end as x, ", ""))
def ord_split_segments(spark, sf):
    rows = _alignments(spark, sf).filter("split is null or (start_pos is not null and split.start_pos is not null)")
    whole = F.when(F.col("split").isNull(), F.array(F.struct("chr", "start_pos"))).otherwise(F.array(F.struct("split.chr", "split.start_pos"), F.struct("chr", "start_pos")))
    return rows.select("aln_id", F.get(I.ordered_segments(whole), F.lit(0))["chr"].alias("first_chr"))


@query(f"""select aln_id, read_name, case when strand = '-' then reverse(translate(s, 'ACGT', 'TGCA')) else s end as query_seq, case when strand = '-' then reverse(q) else q end as qual
    from (select aln_id, read_id, strand from alignment) a left join (select read_id, name as read_name, qual as q, s from {_READS.replace('read_id, ', 'read_id, name, qual, ')}) r using (read_id)""")
def aln_records(spark, sf):
    hits = _alignments(spark, sf).select("aln_id", "read_id", "strand")
    return to_records(hits, read_table(spark, sf, "fastq_read")).select("aln_id", "read_name", "query_seq", "qual")


@query("""with a as (select row_number() over (order by read_id) as n, read_id from fastq_read), b as (select row_number() over (order by seq_id) as n, seq_id from fasta_read)
    select (a.n - 1)::bigint as ordinal, read_id, seq_id from a join b using (n)""")
def join_by_ordinal(spark, sf):
    pairs = O.zip_by_order(read_table(spark, sf, "fastq_read").select("read_id"), read_table(spark, sf, "fasta_read").select("seq_id"), "read_id", "seq_id")
    return pairs.select(F.col("ordinal").cast("bigint").alias("ordinal"), "a.read_id", "b.seq_id")


@query("select interval_id, 1000 - start_pos as to_locus, start_pos + 10 as later, start_pos - 10 as earlier from ginterval where start_pos <= end_pos")
def prd_locus_arithmetic(spark, sf):
    return _intervals(spark, sf).select("interval_id", I.distance(F.col("start_pos"), F.lit(1000)).alias("to_locus"), (F.col("start_pos") + 10).alias("later"), (F.col("start_pos") - 10).alias("earlier"))


@query(f"""with c as (select s, sum(length(s)) over (order by seq_id) - length(s) as o from {_CONTIGS}), q as (select read_id, s as q from {_READS} where read_id % 50 = 0 and length(s) >= 4),
    f as (select read_id, q, s, o, unnest(range(0, length(s) - length(q) + 1)) as p from q join c on contains(s, q)), h as (select read_id, list((o + p)::bigint order by o + p) as l from f where substr(s, p + 1, length(q)) = q group by read_id)
    select read_id, coalesce(array_to_string(l, ','), '') as places from q left join h using (read_id)""")
def idx_exact_search(spark, sf):
    queries = _reads(spark, sf).filter("read_id % 50 = 0 and length(s) >= 4").select("read_id", "s")
    texts = O.concat_offsets(_contigs(spark, sf).select("seq_id", "s", F.length("s").alias("n")), "seq_id", "n")
    found = exact_places(queries, texts).groupBy("read_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda x: x.cast("string")), ",").alias("places"))
    return queries.select("read_id").join(found, "read_id", "left").select("read_id", F.coalesce("places", F.lit("")).alias("places"))


@query(f"select read_id, i, count(*) over (partition by read_id, bwt order by i rows unbounded preceding) - 1 as rank from {_SA}")
def win_letter_rank(spark, sf):
    from pyspark.sql import Window

    bwt = X.suffix_arrays(_reads(spark, sf), "read_id", "s")  # one read's letters per group
    return bwt.select("read_id", "i", (F.count(F.lit(1)).over(Window.partitionBy("read_id", "bwt").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("rank"))


def queries() -> dict:
    return QUERIES


def oracle() -> dict[str, str]:
    return ORACLE
