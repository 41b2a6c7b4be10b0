"""Setting unparseable WIG lines apart, each with its reasons, while the others load.

Lines are taken apart into cells, the cells exploded to (row, column, value) and joined with a table of
rules; broken rules are aggregated per row, and the clean rows are what an anti-join leaves. Which block a
data line belongs to is found without ordering whole files: a file is cut into chunks of ``CHUNK`` line
numbers, the step lines of each chunk are judged once and written, and the last step line is handed on to
later chunks by windows over chunk summaries, first among the chunks of a range, then among ranges. So the
table is read twice: for its step lines, and for the verdict on every line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.session import broadcast_if_small, cut_lineage, is_small

CHUNK = 512
RANGE = 4096
SALTS = 8
MAX_INT = 2**31 - 1

# The notations of the WIG lines.
PAIR = r"""[ \t]+([^ \t="']+)=("[^"]*"|'[^']*'|[^ \t"']+)(?=[ \t]|\z)"""
WORD = r"^(track|variableStep|fixedStep)"
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\z"
WHOLE = r"^0*[1-9][0-9]{0,9}\z"

# Kind of line, column, rule, reason, whether the cell must be there.
RULES = [
    ("null", "line", "present", "line is null", True),
    ("track", "pairs", "well_formed", "not a list of key=value", True),
    ("variableStep", "pairs", "well_formed", "not a list of key=value", True),
    ("fixedStep", "pairs", "well_formed", "not a list of key=value", True),
    ("variableStep", "chrom", "known_chrom", "chrom missing or unknown", True),
    ("fixedStep", "chrom", "known_chrom", "chrom missing or unknown", True),
    ("variableStep", "start", "position", "start not a position of chrom", False),
    ("fixedStep", "start", "position", "start missing or not a position of chrom", True),
    ("variableStep", "step", "whole", "step not a whole number", False),
    ("fixedStep", "step", "whole", "step not a whole number", False),
    ("variableStep", "span", "whole", "span not a whole number", False),
    ("fixedStep", "span", "whole", "span not a whole number", False),
    ("data", "block", "present", "no step line before it", True),
    ("data:variableStep", "columns", "two", "not exactly two columns", True),
    ("data:variableStep", "position", "position", "position not a position of chrom", True),
    ("data:variableStep", "value", "number", "value not a finite number", True),
    ("data:fixedStep", "columns", "one", "not exactly one column", True),
    ("data:fixedStep", "value", "number", "value not a finite number", True),
]


def _kind(line: Column) -> Column:
    return (
        F.when(line.isNull(), "null")
        .when(line.startswith("#"), "comment")
        .when(line.startswith("browser"), "browser")
        .when(line.startswith("track"), "track")
        .when(line.startswith("variableStep"), "variableStep")
        .when(line.startswith("fixedStep"), "fixedStep")
        .otherwise("data")
    )


def _pairs(line: Column) -> tuple[Column, Column]:
    """Whether the line is a word and key=value pairs only; the pairs, quotes taken off."""
    tail = F.regexp_replace(line, WORD, "")
    well = F.regexp_replace(tail, r"\G" + PAIR, "") == ""
    entries = F.arrays_zip(
        F.regexp_extract_all(tail, F.lit(PAIR), F.lit(1)).alias("key"),
        F.transform(F.regexp_extract_all(tail, F.lit(PAIR), F.lit(2)), lambda v: F.regexp_replace(v, r"""^(["'])(.*)\1\z""", "$2")).alias("value"),
    )
    return well, entries


def _last_value(entries: str, key: str) -> Column:
    return F.expr(f"try_element_at(filter({entries}, p -> p.key = '{key}'), -1).value")


def _column(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("column"), value.alias("value"))


def _known(sizes: DataFrame) -> DataFrame:
    return broadcast_if_small(sizes.filter("chr is not null").groupBy("chr").agg(F.max("n_bases").alias("__own_bases")))


def _headed(df: DataFrame, known: DataFrame) -> DataFrame:
    """``df`` with ``__well``, ``__pairs`` and ``__chrom`` of its step and track lines, and ``__own_bases``, the length
    of that chrom; null for other lines."""
    well, entries = _pairs(F.col("__line"))
    step = F.col("__kind").isin("variableStep", "fixedStep")
    head = step | (F.col("__kind") == "track")
    df = df.withColumns({"__well": F.when(head, well), "__pairs": F.when(head, entries)})
    named = df.withColumn("__chrom", F.when(step, _last_value("__pairs", "chrom")))
    return named.join(known, F.col("__chrom") == F.col("chr"), "left").drop("chr")


def _head_cells() -> Column:
    pairs = _column("pairs", F.when(F.col("__well"), "ok"))
    return F.when((F.col("__kind") == "track") | ~F.col("__well"), F.array(pairs)).otherwise(F.array(pairs, *[_column(k, _last_value("__pairs", k)) for k in ("chrom", "start", "step", "span")]))


def _violations(df: DataFrame) -> DataFrame:
    """Explode ``__cells`` of the rows, join the rules on (kind, column); ``__broken`` is the reason of a
    broken one. Rows without cells stay.

    ``__n_bases`` is the length of the row's chrom, null where it is unknown or not to be checked.
    """
    rules = df.sparkSession.createDataFrame(RULES, "__kind string, column string, rule string, reason string, needed boolean")
    cells = df.select("*", F.explode_outer("__cells").alias("cell")).select("*", "cell.column", "cell.value").drop("cell", "__cells")
    joined = cells.join(F.broadcast(rules), ["__kind", "column"], "left")  # the fixed rules
    number = F.expr("try_cast(if(length(ltrim('0', value)) <= 10, value, null) as bigint)")
    whole = F.col("value").rlike(WHOLE) & (number <= MAX_INT)
    inside = F.col("__n_bases").isNull() | (number <= F.col("__n_bases"))
    finite = F.col("value").rlike(NUMBER) & (F.abs(F.expr("try_cast(value as float)")) < F.lit(float("inf")))
    good = F.coalesce(
        F.when(F.col("value").isNull(), ~F.col("needed"))
        .when(F.col("rule").isin("present", "well_formed"), True)
        .when(F.col("rule") == "known_chrom", F.col("__n_bases").isNotNull())
        .when(F.col("rule") == "whole", whole)
        .when(F.col("rule") == "position", whole & inside)
        .when(F.col("rule") == "number", finite)
        .when(F.col("rule") == "two", F.col("value") == "2")
        .when(F.col("rule") == "one", F.col("value") == "1"),
        F.lit(False),
    )
    return joined.withColumn("__broken", F.when(~good, F.col("reason")))


def _judged_steps(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Per file and chunk of line numbers ``__steps``: its step lines in order, one for each line number."""
    step = F.col("__kind").isin("variableStep", "fixedStep") & F.col("__no").isNotNull()
    chunks = rows.filter(step | (F.col("__kind") == "data")).groupBy("__file", "__chunk").agg(F.collect_set(F.when(step, F.struct(F.col("__no").alias("no"), F.col("__line").alias("line")))).alias("lines"))
    lines = (
        chunks.select("__file", "__chunk", F.explode_outer("lines").alias("x"))
        .select("__file", "__chunk", F.col("x.no").alias("__no"), F.col("x.line").alias("__line"))
        .withColumn("__kind", _kind(F.col("__line")))
    )
    cells = _headed(lines, known).withColumns({"__n_bases": F.col("__own_bases"), "__cells": F.when(F.col("__no").isNotNull(), _head_cells())})
    return (
        _violations(cells)
        .groupBy("__file", "__chunk", "__no", "__line")
        .agg(
            F.max(F.struct(F.col("__kind").alias("kind"), F.col("__chrom").alias("chrom"), F.col("__n_bases").alias("n_bases"))).alias("s"),
            (F.count("__broken") == 0).alias("ok"),
            *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in ("start", "step", "span")],
        )
        .groupBy("__file", "__chunk", "__no")
        .agg(F.max(F.struct("__line", "s.kind", "s.chrom", "ok", F.when(F.col("ok"), F.col("s.n_bases")).alias("n_bases"), "start", "step", "span")).alias("s"))
        .groupBy("__file", "__chunk")
        .agg(F.array_sort(F.collect_list(F.when(F.col("__no").isNotNull(), F.struct(F.col("__no").alias("no"), *[F.col(f"s.{c}").alias(c) for c in ("kind", "chrom", "ok", "n_bases", "start", "step", "span")])))).alias("__steps"))
    )


def _blocks(judged: DataFrame) -> DataFrame:
    """``__steps`` of every file and chunk, and ``__carried``, the last step line before the chunk."""
    ends = judged.select("__file", "__chunk", F.expr(f"floor(__chunk / {RANGE})").alias("__range"), F.expr("try_element_at(__steps, -1)").alias("last"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    near = ends.withColumn("near", F.last("last", ignorenulls=True).over(before("__file", "__range", "__chunk")))
    ranges = ends.groupBy("__file", "__range").agg(F.max_by("last", F.when(F.col("last").isNotNull(), F.col("__chunk"))).alias("last"))
    far = ranges.select("__file", "__range", F.last("last", ignorenulls=True).over(before("__file", "__range")).alias("far"))
    carried = near.join(far, ["__file", "__range"]).select("__file", "__chunk", F.coalesce("near", "far").alias("__carried"))
    return judged.join(carried, ["__file", "__chunk"])


def _with_blocks(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with ``__block``, the step line that a data line belongs to.

    Few blocks are broadcast; many are joined by a shuffle in which the rows of one chunk spread over
    ``SALTS`` partitions, as copies of a line may make it hot.
    """
    judged = cut_lineage(_judged_steps(rows, known))
    blocks = _blocks(judged)
    if is_small(judged, max_bytes=16 << 20):  # a block adds at most one step line to its chunk
        joined = rows.join(F.broadcast(blocks), ["__file", "__chunk"], "left")
    else:
        salted = blocks.withColumn("__salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
        salt = F.pmod(F.xxhash64("__id", "__line"), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("__salt", salt).join(salted, ["__file", "__chunk", "__salt"], "left").drop("__salt")
    block = F.when((F.col("__kind") == "data") & F.col("__no").isNotNull(), F.expr("coalesce(try_element_at(filter(__steps, s -> s.no < __no), -1), __carried)"))
    return joined.withColumn("__block", block).drop("__steps", "__carried")


def judge_wig_lines(lines: DataFrame, sizes: DataFrame, id_col: str = "line_id") -> tuple[DataFrame, DataFrame]:
    """Split raw lines (``file_name``, ``line_no``, ``line`` and an id) into rejects and records.

    The first frame has the id, ``line`` and ``reasons`` (sorted array) of every line that fails; the
    second one the id and the parsed record of every other line: ``kind``, ``chrom``, ``start``,
    ``step``, ``span``, ``position``, ``value`` and ``props``.

    A null line fails. A step line that is no list of key=value fails for that alone, as its pairs cannot be
    told. A null file name is a file of its own. A null line number comes after no step
    line, so such a data line fails. Of several step lines with one line number the greatest text counts
    for the data lines after it. Data under a step line that fails has a null chrom, start, step and span.
    Rows that repeat an id share one verdict. Other columns are not read.
    """
    rows = lines.select(
        F.col(id_col).alias("__id"),
        F.struct(F.col("file_name").alias("f")).alias("__file"),
        F.col("line_no").cast("bigint").alias("__no"),
        F.col("line").alias("__line"),
        _kind(F.col("line")).alias("__kind"),
    ).withColumn("__chunk", F.expr(f"coalesce(floor(__no / {CHUNK}), -1)").cast("bigint"))

    data = F.col("__kind") == "data"
    words = F.filter(F.split(F.regexp_replace("__line", r"^[ \t]+|[ \t]+\z", ""), r"[ \t]+"), lambda w: w != "")
    known = _known(sizes)
    parsed = _headed(_with_blocks(rows, known), known).withColumn("__words", F.when(data, words))
    count = _column("columns", F.size("__words").cast("string"))
    under = lambda kind, n: (F.col("__block.kind") == kind) & (F.size("__words") == n)
    data_cells = (
        F.when(F.col("__block").isNull(), F.array(_column("block", F.lit(None).cast("string"))))
        .when(under("variableStep", 2), F.array(count, _column("position", F.get("__words", F.lit(0))), _column("value", F.get("__words", F.lit(1)))))
        .when(under("fixedStep", 1), F.array(count, _column("value", F.get("__words", F.lit(0)))))
        .otherwise(F.array(count))
    )
    cells = parsed.filter(~F.col("__kind").isin("comment", "browser")).select(
        "__id", "__line",
        F.when(data, F.concat_ws(":", F.lit("data"), F.col("__block.kind"))).otherwise(F.col("__kind")).alias("__kind"),
        F.when(data, F.col("__block.n_bases")).otherwise(F.col("__own_bases")).alias("__n_bases"),
        F.when(data, data_cells).when(F.col("__kind") == "null", F.array(_column("line", F.lit(None).cast("string")))).otherwise(_head_cells()).alias("__cells"),
    )
    broken = _violations(cells).filter("__broken is not null")
    rejects = broken.groupBy("__id").agg(F.max("__line").alias("line"), F.sort_array(F.collect_set("__broken")).alias("reasons"))

    whole = lambda c: F.expr(f"try_cast({c} as int)")
    step = F.col("__kind").isin("variableStep", "fixedStep")
    sound = F.col("__block.ok")
    records = parsed.select(
        "__id", F.when(data, F.concat(F.col("__block.kind"), F.lit("Value"))).otherwise(F.col("__kind")).alias("__kind"),
        F.when(data & sound, F.col("__block.chrom")).otherwise(F.col("__chrom")).alias("chrom"),
        *[F.when(data & sound, whole(f"__block.{k}")).when(step, whole(f"try_element_at(filter(__pairs, p -> p.key = '{k}'), -1).value")).alias(k) for k in ("start", "step", "span")],
        F.when(F.col("__block.kind") == "variableStep", whole("get(__words, 0)")).alias("position"),
        F.expr("try_cast(try_element_at(__words, -1) as float)").alias("value"), F.col("__pairs").alias("props"),
    )
    bad = rejects.select(F.col("__id").alias("__bad"))
    clean = records.join(bad, F.col("__id").eqNullSafe(F.col("__bad")), "left_anti")
    return rejects.withColumnRenamed("__id", id_col), clean.withColumnsRenamed({"__id": id_col, "__kind": "kind"})
