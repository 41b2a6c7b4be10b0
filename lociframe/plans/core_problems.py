"""Queries p1, p2 and p3 with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.operators.dyadic import covered_lengths, interval_gaps, merge_intervals
from lociframe.operators.rejects import judge_wig_lines
from lociframe.operators.tree import tree_aggregate
from lociframe.session import read_table


def _judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return judge_wig_lines(read_table(spark, sf, "wig_line"), read_table(spark, sf, "chrom_size"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf)[0].select("line_id")


def p1_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf)[0].select("line_id", F.array_join("reasons", "; ").alias("reasons"))


def p1_records(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf)[1].select("line_id", "kind", "chrom", "start", "step", "span", "position", F.col("value").cast("double").alias("value"))


def _both(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    name = lambda t: read_table(spark, sf, t).select(F.lit(t).alias("table_name"), "chr", *more)
    return name("alignment").unionByName(name("ginterval"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The chr values with at least 3 % of the rows of a table whose chr is not null."""
    counts = tree_aggregate(_both(spark, sf).filter("chr is not null"), ["table_name", "chr"], {"n_rows": ("sum", F.lit(1))})
    totals = tree_aggregate(counts, ["table_name"], {"total": ("sum", F.col("n_rows"))})
    return counts.join(totals, "table_name").filter("n_rows * 100 >= total * 3").select("table_name", "chr")


def p2_by_chr(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, rows with usable coordinates and covered bases of every chr of both tables."""
    both = _both(spark, sf, "start_pos", "end_pos")
    usable = "start_pos >= 1 and start_pos < end_pos and chr <> '*'"
    counts = tree_aggregate(both, ["table_name", "chr"], {"n_rows": ("sum", F.lit(1)), "n_usable": ("sum", F.expr(f"if(coalesce({usable}, false), 1, 0)"))})
    keyed = both.filter(usable).select(F.struct("table_name", "chr").alias("place"), "start_pos", "end_pos")
    cells = covered_lengths(keyed, "place", "start_pos", "end_pos").select("place.table_name", "place.chr", "covered")
    covered = tree_aggregate(cells, ["table_name", "chr"], {"covered_bases": ("sum", F.col("covered"))})
    a, b = counts.alias("a"), covered.alias("b")
    on = (F.col("a.table_name") == F.col("b.table_name")) & F.col("a.chr").eqNullSafe(F.col("b.chr"))
    return a.join(b, on, "left").select("a.table_name", "a.chr", "n_rows", "n_usable", F.coalesce("covered_bases", F.lit(0)).cast("bigint").alias("covered_bases"))


def _usable_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "alignment").select("chr", "start_pos", "end_pos").filter("chr is not null and chr <> '*' and start_pos >= 1 and start_pos < end_pos")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return interval_gaps(_usable_alignment(spark, sf), "chr", "start_pos", "end_pos")


def p3_stretches(spark: SparkSession, sf: str) -> DataFrame:
    return merge_intervals(_usable_alignment(spark, sf), "chr", "start_pos", "end_pos")


_VALUE = """[^ \\t"']+|"[^"]*"|'[^']*'"""
_PAIR = f"""[ \\t]+[^ \\t="']+=({_VALUE})"""
_WHOLE = lambda v: f"(regexp_full_match({v}, '0*[1-9][0-9]{{0,9}}') and try_cast(ltrim({v}, '0') as bigint) <= 2147483647)"
_Q = lambda s: s.replace("'", "''")


def _wig_sql() -> str:
    """Every line with ``fails``, from the statement of the problem."""
    part = lambda k: f"""list_extract(list_transform(list_filter(pairs, lambda p: p[1] = '{k}'), lambda p: p[2]), -1)"""
    return f"""
    with kinds as (
      select line_id, file_name, line_no, line,
        case when line is null then 'null' when starts_with(line, '#') or starts_with(line, 'browser') then 'free'
          when starts_with(line, 'track') then 'track' when starts_with(line, 'variableStep') then 'variableStep'
          when starts_with(line, 'fixedStep') then 'fixedStep' else 'data' end as kind
      from wig_line),
    heads as (
      select *, regexp_replace(line, '^(track|variableStep|fixedStep)', '') as tail,
        list_transform(regexp_extract_all(regexp_replace(line, '^(track|variableStep|fixedStep)', ''), '{_Q(_PAIR)}'),
          lambda x: [regexp_extract(x, '[ \\t]+([^ \\t="'']+)=', 1), regexp_extract(x, '[ \\t]+[^ \\t="'']+=(.*)$', 1, 's')]) as pairs
      from kinds where kind in ('track', 'variableStep', 'fixedStep')),
    named as (
      select * exclude (pairs), regexp_full_match(tail, '({_Q(_PAIR)})*') as well,
        {part("chrom")} as chrom0, {part("start")} as start0, {part("step")} as step0, {part("span")} as span0
      from heads),
    bare as (
      select *, case when chrom0[1] in ('"', '''') then chrom0[2:-2] else chrom0 end as chrom,
        case when start0[1] in ('"', '''') then start0[2:-2] else start0 end as start_at,
        case when step0[1] in ('"', '''') then step0[2:-2] else step0 end as step,
        case when span0[1] in ('"', '''') then span0[2:-2] else span0 end as span
      from named),
    judged as (
      select b.*, c.n_bases, case when kind = 'track' then not well else not (
          coalesce(well, false) and c.chr is not null and coalesce({_WHOLE("step")}, step is null) and coalesce({_WHOLE("span")}, span is null)
          and case when start_at is null then kind = 'variableStep' else {_WHOLE("start_at")} and try_cast(ltrim(start_at, '0') as bigint) <= c.n_bases end) end as fails
      from bare b left join chrom_size c on b.chrom = c.chr),
    steps as (
      select file_name, line_no, max_by(struct_pack(kind := kind, fails := fails, chrom := chrom, start_at := start_at, step := step, span := span, n_bases := n_bases), line) as s
      from judged where kind <> 'track' and line_no is not null group by all),
    placed as (
      select k.line_id, k.line, s.s, s.line_no as at, regexp_split_to_array(trim(k.line, ' \t'), '[ \\t]+') as w
      from (select * from kinds where kind = 'data') k asof left join steps s on k.file_name = s.file_name and k.line_no > s.line_no),
    valued as (
      select *, case when w = [''] then 0 else len(w) end as n, w[-1] as v,
        regexp_full_match(w[-1], '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') and coalesce(isfinite(try_cast(w[-1] as float)), false) as good
      from placed),
    data as (
      select line_id, s, w, v, case when s is null then true
        when s.kind = 'fixedStep' then n <> 1 or not good
        else n <> 2 or not good or not coalesce({_WHOLE("w[1]")} and (s.fails or try_cast(ltrim(w[1], '0') as bigint) <= s.n_bases), false) end as fails
      from valued)"""


def oracle() -> dict[str, str]:
    found = _wig_sql() + """
    select line_id from judged where fails union all select line_id from data where fails union all select line_id from kinds where kind = 'null'"""
    records = _wig_sql() + """
    select line_id, kind, case when kind <> 'track' then chrom end as chrom, case when kind <> 'track' then try_cast(start_at as int) end as start,
      case when kind <> 'track' then try_cast(step as int) end as step, case when kind <> 'track' then try_cast(span as int) end as span,
      cast(null as int) as position, cast(null as double) as value from judged where not fails
    union all select line_id, case when starts_with(line, '#') then 'comment' else 'browser' end, null, null, null, null, null, null from kinds where kind = 'free'
    union all select line_id, s.kind || 'Value', case when not s.fails then s.chrom end, case when not s.fails then try_cast(s.start_at as int) end, case when not s.fails then try_cast(s.step as int) end, case when not s.fails then try_cast(s.span as int) end,
      case when s.kind = 'variableStep' then try_cast(w[1] as int) end, cast(try_cast(v as float) as double) from data where not fails"""
    within = lambda v: f"({_WHOLE(v)} and coalesce(try_cast(ltrim({v}, '0') as bigint) <= n_bases, true))"
    listed = lambda *cases: "array_to_string(list_sort(list_filter([" + ", ".join(f"case when {test} then '{reason}' end" for test, reason in cases) + "], lambda x: x is not null)), '; ')"
    head_reasons = listed(
        ("not coalesce(well, false)", "not a list of key=value"), ("well and kind <> 'track' and n_bases is null", "chrom missing or unknown"),
        (f"well and kind = 'variableStep' and start_at is not null and not {within('start_at')}", "start not a position of chrom"), (f"well and kind = 'fixedStep' and (start_at is null or not {within('start_at')})", "start missing or not a position of chrom"),
        (f"well and kind <> 'track' and step is not null and not {_WHOLE('step')}", "step not a whole number"), (f"well and kind <> 'track' and span is not null and not {_WHOLE('span')}", "span not a whole number"),
    )
    data_reasons = listed(
        ("s is null", "no step line before it"), ("s.kind = 'variableStep' and n <> 2", "not exactly two columns"), ("s.kind = 'fixedStep' and n <> 1", "not exactly one column"),
        (f"s.kind = 'variableStep' and n = 2 and not coalesce({_WHOLE('w[1]')} and (s.fails or try_cast(ltrim(w[1], '0') as bigint) <= s.n_bases), false)", "position not a position of chrom"),
        ("n = case s.kind when 'variableStep' then 2 else 1 end and s is not null and not good", "value not a finite number"),
    )
    rejects = _wig_sql().replace("select line_id, s, w, v, case when s is null", "select *, case when s is null") + f"""
    select line_id, {head_reasons} as reasons from judged where fails union all select line_id, {data_reasons} from data where fails union all select line_id, 'line is null' from kinds where kind = 'null'"""
    both = """(select 'alignment' as table_name, chr, start_pos, end_pos from alignment union all select 'ginterval', chr, start_pos, end_pos from ginterval)"""
    runs = """
    select {k}, start_pos, end_pos, max(end_pos) over (partition by {k} order by start_pos, end_pos rows between unbounded preceding and 1 preceding) as reach
    from {t} where chr is not null and chr <> '*' and start_pos >= 1 and start_pos < end_pos"""
    align = runs.format(k="chr", t="alignment")
    return {
        "p1_found": found,
        "p1_rejects": rejects,
        "p1_records": records,
        "p2_found": f"""with n as (select table_name, chr, count(*) as n from {both} where chr is not null group by all)
    select table_name, chr from n qualify n * 100 >= 3 * sum(n) over (partition by table_name)""",
        "p2_by_chr": f"""with r as ({runs.format(k="table_name, chr", t=both)}),
    c as (select table_name, chr, cast(sum(greatest(0, end_pos - greatest(start_pos, coalesce(reach, 0)))) as bigint) as covered_bases from r group by all),
    n as (select table_name, chr, count(*) as n_rows, cast(count(*) filter (chr <> '*' and start_pos >= 1 and start_pos < end_pos) as bigint) as n_usable from {both} group by all)
    select n.table_name, n.chr, n_rows, n_usable, coalesce(covered_bases, 0) as covered_bases from n left join c on n.table_name = c.table_name and n.chr = c.chr""",
        "p3_found": f"select chr, reach as gap_start, start_pos as gap_end from ({align}) where reach < start_pos",
        "p3_stretches": f"""with r as ({align}), g as (select *, sum(case when reach is null or reach < start_pos then 1 else 0 end) over (partition by chr order by start_pos, end_pos rows unbounded preceding) as g from r)
    select chr, min(start_pos) as stretch_start, max(end_pos) as stretch_end from g group by chr, g""",
    }


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_rejects, p1_records, p2_found, p2_by_chr, p3_found, p3_stretches)}
