"""Nucleotide sequences as STRING columns: built-in expressions but for one.

A null sequence gives null everywhere; an empty one gives empty strings, zero counts and empty arrays.
Positions are 0-based and half-open.
"""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC codes as sets of bases (bit 1 A, 2 C, 4 G, 8 T), complement pairs in order.
IUPAC_BITS = {"A": 1, "C": 2, "M": 3, "G": 4, "R": 5, "S": 6, "V": 7, "T": 8, "W": 9, "Y": 10, "H": 11, "K": 12, "D": 13, "B": 14, "N": 15}
IUPAC_FROM, IUPAC_TO = "ACGTRYMKWSBVDHN", "TGCAYRKMWSVBHDN"


def normalized(seq: Column) -> Column:
    """White space dropped, lower case raised, U read as T, every other letter N."""
    return F.regexp_replace(F.translate(F.regexp_replace(seq, r"\s+", ""), "acgtuU", "ACGTTT"), "[^ACGT]", "N")


def reverse(seq: Column) -> Column:
    return F.reverse(seq)


def complement(seq: Column) -> Column:
    """Per base, not reversed; N stays."""
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def slice_of(seq: Column, start: Column | int, end: Column | int) -> Column:
    """``[start, end)``; an error for start > end, as a wrong slice would pass unseen."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return F.when(F.assert_true(a <= b, "slice with start > end").isNull(), F.substring(seq, a + 1, b - a))


def base_count(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))


def base_counts(seq: Column, alphabet: str = "ACGT") -> Column:
    """Array of counts in the order of ``alphabet``; ACGTN counts N as well."""
    return F.array(*[base_count(seq, b) for b in alphabet])


def n_as_a(seq: Column) -> Column:
    """N read as A, which is what a 2-bit store keeps."""
    return F.translate(seq, "N", "A")


def base_codes(seq: Column) -> Column:
    """A0 C1 G2 T3 and 4 for everything else."""
    return F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), lambda c: F.coalesce(F.nullif(F.instr(F.lit("ACGT"), c) - 1, F.lit(-1)), F.lit(4)))


def from_codes(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.substring(F.lit("ACGTN"), c + 1, 1)), "")


def replace_base(seq: Column, at: Column | int, base: Column | str) -> Column:
    """The base at one position overwritten."""
    return F.overlay(seq, base if isinstance(base, Column) else F.lit(base), (at if isinstance(at, Column) else F.lit(at)) + 1)


def positions_of(seq: Column, pattern: str) -> Column:
    """All, also overlapping, places of ``pattern``; an empty pattern is nowhere.

    The text is cut into tiles, each with the first letters of the next one, so a long text costs no more
    per letter than a short one.
    """
    none = F.array().cast("array<int>")
    if not pattern:
        return F.when(seq.isNotNull(), none)
    m = len(pattern)
    size = max(256, m)
    tiles = F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    longer = F.zip_with(tiles, F.slice(tiles, 2, F.size(tiles)), lambda x, y: F.concat(x, F.substring(F.coalesce(y, F.lit("")), 1, m - 1)))
    inside = F.transform(longer, lambda x, t: F.transform(F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.substring(x, i + 1, F.lit(m)) == pattern), lambda i: i + t * size))
    return F.when(seq.isNotNull(), F.when(F.length(seq) >= m, F.flatten(inside)).otherwise(none))


def rotated_left(seq: Column, by: int) -> Column:
    return F.concat(F.substring(seq, F.lit(by + 1), F.length(seq)), F.substring(seq, 1, by))


def bases_match(a: Column, b: Column) -> Column:
    """Two bases match if their IUPAC sets meet, so N matches all."""
    bits = F.create_map(*[F.lit(x) for pair in IUPAC_BITS.items() for x in pair])
    return F.coalesce(F.try_element_at(bits, a), F.lit(15)).bitwiseAND(F.coalesce(F.try_element_at(bits, b), F.lit(15))) != 0


def iupac_normalized(seq: Column) -> Column:
    """White space dropped, upper case, U read as T, every letter that is no IUPAC code N."""
    upper = F.translate(F.regexp_replace(seq, r"\s+", ""), "acgturymkwsbvdhnU", "ACGTTRYMKWSBVDHNT")
    return F.regexp_replace(upper, f"[^{IUPAC_FROM}]", "N")


def iupac_complement(seq: Column) -> Column:
    return F.translate(seq, IUPAC_FROM, IUPAC_TO)


def iupac_reverse(seq: Column) -> Column:
    """Reversed, a closing ``$`` stays last."""
    return F.when(seq.endswith("$"), F.concat(F.reverse(F.regexp_replace(seq, r"\$$", "")), F.lit("$"))).otherwise(F.reverse(seq))


def iupac_code(genotype: Column) -> Column:
    """The one-letter code of a set of bases such as ``AG``; bases may repeat and come in any order."""
    bit = lambda b, v: F.when(F.contains(genotype, F.lit(b)), v).otherwise(0)
    codes = F.create_map(*[F.lit(x) for k, v in IUPAC_BITS.items() for x in (v, k)])
    return F.try_element_at(codes, bit("A", 1) + bit("C", 2) + bit("G", 4) + bit("T", 8))


def genotype_of(code: Column) -> Column:
    """The bases that a one-letter code stands for, in the order A, C, G, T; null for other letters."""
    listed = {k: "".join(b for i, b in enumerate("ACGT") if v >> i & 1) for k, v in IUPAC_BITS.items()}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in listed.items() for x in pair]), code)


def appended(seq: Column, more: Column) -> Column:
    """``seq`` and ``more`` behind it; null if either is."""
    return F.concat(seq, more)


def iupac_to_acgt(seq: Column) -> Column:
    """Ambiguity codes read as N."""
    return F.regexp_replace(seq, "[^ACGT$]", "N")


def color_encode(seq: Column, lead: str = "T") -> Column:
    """Two-base colors 0 to 3 (XOR of 2-bit codes) of ``lead`` followed by ``seq``; N gives ``.``."""
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    code = lambda c: F.instr(F.lit("ACGT"), c) - 1
    pair = lambda x, y: F.when((code(x) < 0) | (code(y) < 0), ".").otherwise(code(x).bitwiseXOR(code(y)).cast("string"))
    before = F.slice(F.concat(F.array(F.lit(lead)), letters), F.lit(1), F.size(letters))
    return F.when(seq.isNotNull(), F.array_join(F.zip_with(before, letters, pair), ""))


def color_decode(colors: Column, lead: str = "T") -> Column:
    """Bases of a color string: a running XOR from the lead; after a ``.`` all bases are N.

    A running value over letters has no linear built-in form, so this one is an Arrow batch function.
    """

    @F.pandas_udf("string")
    def decode(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            known = text.split(".", 1)[0]
            steps = accumulate(map(int, known), lambda a, b: a ^ b, initial="ACGT".index(lead))
            return "".join("ACGT"[x] for x in steps)[1:] + "N" * (len(text) - len(known))

        return texts.map(one)

    return decode(colors)


def color_reverse_complement(colors: Column, lead: str = "T") -> Column:
    """Colors of the reverse complement of the bases that ``colors`` stands for."""
    return color_encode(reverse_complement(color_decode(colors, lead)), lead)


def fasta_name(description: Column) -> Column:
    """Sequence name: ``>`` and blanks off, cut at the first blank or ``|``."""
    return F.regexp_extract(description, r"^>?\s*([^\s|]*)", 1)


def wrapped(seq: Column, width: int = 50) -> Column:
    """Line breaks after every ``width`` letters, none at the end."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def max_edit_distance(k: float, length: Column) -> Column:
    """A k under 1 is a share of the read length, otherwise a number of edits."""
    return F.floor(F.lit(k) * length).cast("int") if 0 < k < 1 else F.lit(int(k))
