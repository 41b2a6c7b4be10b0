"""Intervals as columns: half-open ``[start, end)``, optionally with chr and strand.

Three notions of overlap are offered by ``mode``: ``strict`` (share a position), ``touching`` (also end to
start) and ``asymmetric`` (strict on one side, touching on the other). Null bounds give null, which filters
drop.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strand_of(strand: Column) -> Column:
    """``+`` is forward, anything else reverse; null stays null."""
    return F.when(strand == "+", "+").when(strand.isNotNull(), "-")


def overlaps(s: Column, e: Column, os: Column, oe: Column, mode: str = "strict") -> Column:
    if mode == "strict":
        return (s < oe) & (os < e)
    if mode == "touching":
        return (s <= oe) & (os <= e)
    if mode == "asymmetric":
        return (s < oe) & (os <= e)
    raise ValueError(f"unknown mode {mode}")


def contains(s: Column, e: Column, os: Column, oe: Column) -> Column:
    return (s <= os) & (oe <= e)


def contains_position(s: Column, e: Column, pos: Column) -> Column:
    return (s <= pos) & (pos < e)


def intersection(s: Column, e: Column, os: Column, oe: Column) -> Column:
    """Struct of start and end; touching intervals give an empty one, others further apart null."""
    a, b = F.greatest(s, os), F.least(e, oe)
    return F.when(a <= b, F.struct(a.alias("start"), b.alias("end")))


def five_prime(s: Column, e: Column, strand: Column) -> Column:
    return F.when(strand == "+", s).otherwise(e)


def three_prime(s: Column, e: Column, strand: Column) -> Column:
    return F.when(strand == "+", e).otherwise(s)


def around(pos: Column, strand: Column, upstream: int, downstream: int) -> Column:
    """Struct of a range around a locus; up and down follow the strand."""
    return F.struct(
        (pos - F.when(strand == "+", upstream).otherwise(downstream)).alias("start"),
        (pos + F.when(strand == "+", downstream).otherwise(upstream)).alias("end"),
    )


def upstream(pos: Column, strand: Column, length: int) -> Column:
    return F.struct(F.when(strand == "+", pos - length).otherwise(pos).alias("start"), F.when(strand == "+", pos).otherwise(pos + length).alias("end"))


def downstream(pos: Column, strand: Column, length: int) -> Column:
    return F.struct(F.when(strand == "+", pos).otherwise(pos - length).alias("start"), F.when(strand == "+", pos + length).otherwise(pos).alias("end"))


def move(pos: Column, strand: Column, by: int) -> Column:
    """Along the strand."""
    return F.when(strand == "+", pos + by).otherwise(pos - by)


def distance(pos: Column, other: Column) -> Column:
    """Signed, from ``pos`` to ``other``."""
    return other - pos


def ordered_segments(segments: Column) -> Column:
    """Segments (structs with chr and start_pos) by chr and start; those without a chr last, by start."""
    return F.array_sort(segments, lambda x, y: F.when(x["chr"].isNull() & y["chr"].isNotNull(), 1).when(x["chr"].isNotNull() & y["chr"].isNull(), -1)
                        .when(F.coalesce(x["chr"] < y["chr"], F.lit(False)), -1).when(F.coalesce(x["chr"] > y["chr"], F.lit(False)), 1)
                        .when(F.coalesce(x["start_pos"] < y["start_pos"], F.lit(False)), -1).when(F.coalesce(x["start_pos"] > y["start_pos"], F.lit(False)), 1).otherwise(0))


def region(text: Column) -> Column:
    """``chr[:start[-end]]`` with commas in numbers: start 0 if missing, end as start."""
    plain = F.regexp_replace(text, ",", "")
    part = lambda i: F.regexp_extract(plain, r"^([^:]+)(?::(\d+)(?:-(\d+))?)?$", i)
    start = F.coalesce(F.try_to_number(F.nullif(part(2), F.lit("")), F.lit("9999999999")).cast("int"), F.lit(0))
    end = F.coalesce(F.try_to_number(F.nullif(part(3), F.lit("")), F.lit("9999999999")).cast("int"), start)
    return F.struct(part(1).alias("chr"), start.alias("start"), end.alias("end"))


def exons(start: Column, sizes: Column, starts: Column) -> Column:
    """Array of structs from block sizes and block starts, relative to ``start``."""
    return F.zip_with(starts, sizes, lambda b, n: F.struct((start + b).alias("start"), (start + b + n).alias("end")))


def clipped_to(blocks: Column, s: Column, e: Column) -> Column:
    """The parts of the blocks inside a range (coding part of exons); empty parts fall away."""
    cut = F.transform(blocks, lambda x: F.struct(F.greatest(x["start"], s).alias("start"), F.least(x["end"], e).alias("end")))
    return F.filter(cut, lambda x: x["start"] < x["end"])


def gaps_between(blocks: Column) -> Column:
    """Ranges between neighbouring blocks (introns)."""
    n = F.size(blocks)
    return F.when(n < 2, F.slice(F.transform(blocks, lambda x: F.struct(x["end"].alias("start"), x["start"].alias("end"))), 1, 0)).otherwise(
        F.zip_with(F.slice(blocks, 1, F.greatest(n - 1, F.lit(0))), F.slice(blocks, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a["end"].alias("start"), b["start"].alias("end")))
    )


def first_block(blocks: Column, strand: Column) -> Column:
    """First block in reading direction; null if there is none."""
    return F.try_element_at(blocks, F.when(strand == "+", 1).otherwise(-1))


def last_block(blocks: Column, strand: Column) -> Column:
    return F.try_element_at(blocks, F.when(strand == "+", -1).otherwise(1))


def span_of(blocks: Column) -> Column:
    """Start of the first and end of the last block, such as those of the coding part; null without blocks."""
    return F.when(F.size(blocks) > 0, F.struct(F.get(blocks, F.lit(0))["start"].alias("start"), F.try_element_at(blocks, F.lit(-1))["end"].alias("end")))
