"""CIGAR strings and SAM lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SAM flag bits.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY = 1, 2, 4, 8, 16, 32, 64, 128, 256


def parse_cigar(cigar: Column) -> Column:
    """Array of structs (op, len); ``=`` is kept as it stands, text that is no CIGAR is skipped."""
    return F.transform(
        F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHPX=])"), F.lit(0)),
        lambda x: F.struct(F.substring(x, -1, 1).alias("op"), F.expr("1").cast("int").alias("one"), F.regexp_extract(x, r"^(\d+)", 1).cast("int").alias("len")).dropFields("one"),
    )


def render_cigar(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def merge_runs(ops: Column) -> Column:
    """Neighbouring elements of one type joined."""
    kind = "array<struct<op:string,len:int>>"
    join = lambda acc, x: F.when(
        F.try_element_at(acc, F.lit(-1))["op"] == x["op"],
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(x["op"].alias("op"), (F.try_element_at(acc, F.lit(-1))["len"] + x["len"]).alias("len")))),
    ).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(ops, F.array().cast(kind), join)


def append_cigar(a: Column, b: Column) -> Column:
    """Two CIGAR strings joined, runs merged at the seam."""
    return render_cigar(merge_runs(F.concat(parse_cigar(a), parse_cigar(b))))


def length_of(cigar: Column, ops: str) -> Column:
    """Total length of the elements whose type is in ``ops``."""
    return F.aggregate(F.filter(parse_cigar(cigar), lambda x: F.contains(F.lit(ops), x["op"])), F.lit(0), lambda acc, x: acc + x["len"])


def unclipped_size(cigar: Column) -> Column:
    """Reference span with soft and hard clips counted; insertions take no room."""
    return length_of(cigar, "MDNSHPX=")


def hit_score(matches: Column, differences: Column, splits: Column, match: int = 1, mismatch: int = 3, split: int = 11) -> Column:
    return matches * match - differences * mismatch - splits * split


def alignment_state(best_hits: Column) -> Column:
    """U unique, R repeat, N no hit."""
    return F.when(best_hits == 1, "U").when(best_hits > 1, "R").otherwise("N")


def sam_flag(strand: Column, best_hits: Column, split: Column, split_hits: Column | None = None) -> Column:
    """Flag bits of the first (or only) segment. As in the records' own convention, a mapped single-end
    read counts as first and properly paired too."""
    on = lambda cond, bit: F.when(cond, bit).otherwise(0)
    hits = F.coalesce(best_hits, F.lit(0))
    mate = hits if split_hits is None else F.coalesce(split_hits, F.lit(0))
    whole = (hits > 0) & (split.isNull() | (mate > 0))
    return (
        on(split.isNotNull(), PAIRED).bitwiseOR(on(whole, PROPER)).bitwiseOR(on(hits <= 0, UNMAPPED)).bitwiseOR(on(split.isNotNull() & (mate <= 0), MATE_UNMAPPED))
        .bitwiseOR(on(strand == "-", REVERSE)).bitwiseOR(F.lit(FIRST))
    )


def sam_line(r: dict[str, Column]) -> Column:
    """One SAM line from the columns of an alignment record; nulls print as ``*`` or 0.

    A split names the other segment in RNEXT, PNEXT and TLEN (its end less this start).
    """
    split = r["split"]
    text = lambda c, none: F.coalesce(c.cast("string"), F.lit(none))
    mapped = F.coalesce(r["num_best_hits"], F.lit(0)) > 0
    return F.concat_ws(
        "\t",
        text(r["read_name"], "*"), sam_flag(r["strand"], r["num_best_hits"], split).cast("string"), text(r["chr"], "*"), text(r["start_pos"], "0"), text(r["score"], "0"), text(r["cigar"], "*"),
        F.when(split.isNull(), "*").when((split["chr"] == r["chr"]) & (r["chr"] != "*"), "=").otherwise(text(split["chr"], "*")),
        F.when(split.isNull(), "0").otherwise(text(split["start_pos"], "0")), F.when(split.isNull(), "0").otherwise(text(split["end_pos"] - r["start_pos"], "0")),
        text(r["query_seq"], "*"), text(r["qual"], "*"),
        F.when(mapped & (r["num_mismatches"] >= 0), F.concat(F.lit("NM:i:"), r["num_mismatches"].cast("string"))),
        F.when(mapped, F.concat(F.lit("XP:Z:"), r["alignment_state"])),
        F.when(mapped, F.concat(F.lit("X0:i:"), r["num_best_hits"].cast("string"))),
    )


def sam_header(name: Column, length: Column) -> Column:
    return F.concat(F.lit("@SQ\tSN:"), name, F.lit("\tLN:"), length.cast("string"))
