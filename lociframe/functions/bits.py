"""Bit vectors of up to 64 positions as BIGINT columns; bit 0 is position 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_bits(text: Column) -> Column:
    """A string of 0 and 1, position 0 first, at most 63 long."""
    return F.conv(F.reverse(text), 2, 10).cast("bigint")


def one_bits(word: Column, start: int = 0, end: int = 64) -> Column:
    """Set bits in ``[start, end)``."""
    width = end - start
    mask = F.lit((1 << width) - 1) if width < 63 else F.lit(-1 if width == 64 else (1 << 63) - 1)
    return F.bit_count(F.shiftrightunsigned(word.cast("bigint"), start).bitwiseAND(mask.cast("bigint")))


def set_bit(word: Column, at: Column) -> Column:
    return word.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at.cast("int")))


def clear_bit(word: Column, at: Column) -> Column:
    return word.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), at.cast("int"))))


def rank_one(word: Column, at: Column) -> Column:
    """Set bits before position ``at`` (0 to 63)."""
    below = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.cast("int")) - 1
    return F.bit_count(word.bitwiseAND(below))


def select_one(word: Column, nth: Column) -> Column:
    """Position of the set bit with ``nth`` set bits before it; null if there is none."""
    on = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", word, i).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    return F.get(on, nth)


def shifted(word: Column, by: int) -> Column:
    """Bits moved to higher positions, or to lower ones for a negative ``by``; what leaves the 64 positions is lost."""
    word = word.cast("bigint")
    if abs(by) >= 64:
        return F.when(word.isNotNull(), F.lit(0).cast("bigint"))
    return F.shiftleft(word, by) if by >= 0 else F.shiftrightunsigned(word, -by)


def sum_of(a: Column, b: Column) -> Column:
    """Sum of two words as 64-bit numbers, a carry out of the last position being lost, without an overflow error."""
    low = F.lit((1 << 32) - 1).cast("bigint")
    a, b = a.cast("bigint"), b.cast("bigint")
    first = a.bitwiseAND(low) + b.bitwiseAND(low)
    second = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(first, 32)
    return F.shiftleft(second, 32).bitwiseOR(first.bitwiseAND(low))


def interleaved(word: Column) -> Column:
    """Bits 0 to 31 moved to the even positions, zeros between them."""
    word = word.cast("bigint").bitwiseAND(F.lit((1 << 32) - 1).cast("bigint"))
    for step in (16, 8, 4, 2, 1):
        block = (1 << step) - 1
        mask = sum(block << at for at in range(0, 64, 2 * step))
        word = word.bitwiseOR(F.shiftleft(word, step)).bitwiseAND(F.lit(mask).cast("bigint"))
    return word
