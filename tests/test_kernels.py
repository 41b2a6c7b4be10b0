"""Alignment kernels, text index and mapper: known cases and brute force."""

import random

import numpy as np
import pytest

from lociframe.operators.kernels import Scores, edit_align, edit_distance, local_align, map_in_window, reverse_complement
from lociframe.operators.textindex import BidirectionalIndex, FMIndex, cyclic_suffix_array, distributed_suffix_array, write_index, write_index_set
from lociframe.operators.mapper import map_reads, trim_adapter


@pytest.mark.parametrize("banded", [False, True])
@pytest.mark.parametrize(
    "window, query, gaps, cigar, position, differences",
    [
        ("GATATAGAGATCTGGCCTAG", "TAGAGAT", (11, 4), "7M", 4, 0),
        ("GATATAGAGATCTGGCCTAG", "TATACAGATCTGGCCTAG", (11, 4), "4M1X13M", 2, 1),
        ("TATACCAAGATATAGATCTGGCAAGTGTGTTAT", "TACCAAGATATAGAGATCTGGCAAGTGTGTTAT", (5, 2), "11M2I20M", 2, 2),
        ("TATACCAAGATATAGAGATCTGGCAAGTGTGTTAT", "TACCAAGATATAGATCTGGCAAGTGTGTTAT", (5, 2), "11M2D20M", 2, 2),
        ("ATTTGTATTATACCAAGAT", "ACCGGAAGGACCAAGAT", (11, 4), "9S8M", 11, 0),
    ],
)
def test_local_alignment(window, query, gaps, cigar, position, differences, banded):
    a = local_align(window, query, Scores(gap_open=gaps[0], gap_extend=gaps[1]), banded)
    assert (a.cigar, a.position, a.differences) == (cigar, position, differences)


def test_local_alignment_special_cases():
    assert local_align("AAAA", "TTTT") is None and local_align("", "A") is None and local_align("A", "") is None
    assert local_align("ACNT", "ACGT").cigar == "4M"
    assert local_align("ACCA", "ATTA", Scores(bisulfite=0)).score == 2


@pytest.mark.parametrize(
    "window, query, cigar, position, differences",
    [
        ("TATACCAAGATCTAGAGATCTGG", "TACCAAGATAGAGATCTGG", "8M2D11M", 2, 2),
        ("GATCTA", "GCTATA", "6M", 0, 2),
        ("TATACCAAGATCTAGAGATCTGG", "TACCAAGATCTCTAGAGATCTGG", "8M2I13M", 2, 2),
        ("TATACCAAGATCTAGAGATCTGG", "ACCAAGATCTAGAG", "14M", 3, 0),
        ("TATACCAAGATCTAGAGATCTGG", "GGCGCACCAAGATCTAGAG", "5S14M", 3, 0),
        ("TATACCAAGATCTAGAGTCTGG", "ACCAAGATCTAGAGAAAA", "14M4S", 3, 0),
    ],
)
def test_edit_alignment(window, query, cigar, position, differences):
    a = edit_align(window, query)
    assert (a.cigar, a.position, a.differences) == (cigar, position, differences)


def test_every_substring_maps_to_itself():
    text = "GCTTCAGTTTCCTGACACTTAAAAAAAAAAGAGTTGCTTATTATTTTAATGAGACTAATGCTTACACTCTG"
    for k in range(30, len(text), 7):
        for i in range(len(text) - k):
            a = edit_align(text, text[i : i + k])
            assert (a.position, a.cigar, a.differences) == (i, f"{k}M", 0)


def test_edit_distance_equals_the_matrix():
    rng = random.Random(1)
    for _ in range(150):
        w = "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 30)))
        q = "".join(rng.choice("ACGTN") for _ in range(rng.randrange(1, 15)))
        row = list(range(len(q) + 1))
        ends = [row[-1]]
        for c in w:
            new = [0]
            for i, x in enumerate(q, 1):
                new.append(min(row[i - 1] + (x not in (c, "N")), row[i] + 1, new[-1] + 1))
            row = new
            ends.append(row[-1])
        assert edit_distance(w, q) == (min(ends), ends.index(min(ends)))


TEXT = "AAGCCTAGTTTCCTTG"


@pytest.mark.parametrize(
    "read, cigar, start, strand, differences",
    [
        ("GCCTAC", "5M1S", 3, "+", 0), ("GCCAAGTT", "8M", 3, "+", 1), (reverse_complement("GCGTAGTT"), "8M", 3, "-", 1), ("AACCCTAGTTTCGTT", "15M", 1, "+", 2), (reverse_complement("AACCCTAGTTTCGTT"), "15M", 1, "-", 2),
        ("TTGCCTAGTTT", "2S9M", 3, "+", 0), ("GCCTAGT", "7M", 3, "+", 0), (reverse_complement("GCCTAGT"), "7M", 3, "-", 0), ("AAGCCTAGATTCCGTG", "16M", 1, "+", 2), ("AAGCCTAGTTAAAAAA", "10M6S", 1, "+", 0),
        ("TTTTTTGAGTTTCCTTG", "7S10M", 7, "+", 0), ("AAGCCTGTTT", "6M1D4M", 1, "+", 1), ("AAGCCTCAGTT", "6M1I4M", 1, "+", 1), ("AAGCCAATAGTTT", "5M2I6M", 1, "+", 2),
    ],
)
def test_mapping_in_one_text(read, cigar, start, strand, differences):
    h = map_in_window(read, TEXT, 2)[0]
    assert (h.cigar, h.start, h.strand, h.differences, h.split) == (cigar, start, strand, differences, None)


def test_split_mapping():
    for read, strand in (("AAGCCTATCCTTG", "+"), (reverse_complement("AAGCCTATCCTTG"), "-")):
        h = map_in_window(read, TEXT, 2)[0]
        assert (h.cigar, h.start, h.strand) == ("7M", 1, strand) and (h.split.cigar, h.split.start, h.split.strand) == ("6M", 11, strand)


def test_cyclic_suffix_arrays():
    assert cyclic_suffix_array([3, 2, 2, 3, 1, 0]).tolist() == [5, 4, 1, 2, 3, 0]
    letters = lambda t: [ord(c) for c in t] + [0]
    assert cyclic_suffix_array(letters("mmiissiissiippii")).tolist() == [16, 15, 14, 10, 6, 2, 11, 7, 3, 1, 0, 13, 12, 9, 5, 8, 4]
    assert cyclic_suffix_array(letters("TATAATAATATAATA")).tolist() == [15, 14, 11, 3, 6, 12, 9, 1, 4, 7, 13, 10, 2, 5, 8, 0]
    assert cyclic_suffix_array([]).tolist() == []


def test_backward_search_steps():
    index = FMIndex("TATAATAATATAATA", sentinel=False)
    lo, hi, out = 0, 15, []
    for letter in "TATAA":
        lo, hi = index.step(letter, lo, hi)
        out.append((lo, hi))
    assert out == [(9, 15), (3, 9), (12, 15), (6, 9), (1, 3)]
    rng = random.Random(4)
    text = "".join(rng.choice("ACGT") for _ in range(300))
    index = FMIndex(text)
    for _ in range(100):
        p = text[(a := rng.randrange(290)) : a + rng.randrange(1, 9)]
        assert index.search(p) == [i for i in range(len(text)) if text.startswith(p, i)]
    assert index.search("ACGTACGTACGTACGTACGT") == []
    walk, at = [], int(np.flatnonzero(index.sa == len(text))[0])
    for _ in range(len(text)):
        walk.append(text[index.sa[at] - 1])
        at = index.last_to_first(at)
    assert "".join(reversed(walk)) == text


def test_quick_scan():
    count, breaks, longest = FMIndex("AAGCCTAGTTTCCTTG").longest_segments("AAGCCTAGATTTCC")
    assert count == 1 and breaks == [8] and longest == (0, 8)


def test_distributed_suffix_array(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("AC") for _ in range(200)) + "ACACACAC" * 10
    rows = [(i, ord(c)) for i, c in enumerate(text)] + [(len(text), 0)]
    sa = distributed_suffix_array(spark.createDataFrame(rows, "pos bigint, letter int"), len(rows), parts=3).orderBy("i").collect()
    assert [r.pos for r in sa] == cyclic_suffix_array([c for _, c in rows]).tolist()
    assert [r.i for r in sa] == list(range(len(rows)))


def test_mapper_finds_planted_reads(spark):
    rng = random.Random(9)
    contigs = [(f"c{i}", "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate((9000, 5000, 60))]
    reads, truth = [], {}
    for i in range(120):
        name, seq = rng.choice(contigs[:2])
        at = rng.randrange(len(seq) - 90)
        read = list(seq[at + 5 : at + 85])
        for p in rng.sample(range(10, 70), i % 3):
            read[p] = rng.choice([b for b in "ACGT" if b != read[p]])
        read = "".join(read)
        strand = "-" if i % 2 else "+"
        reads.append((i, reverse_complement(read) if strand == "-" else read, "x"))
        truth[i] = (name, strand, at + 6, i % 3)
    reads += [(500, "N" * 80, "x"), (501, None, "x"), (502, "", "x"), (503, "".join(rng.choice("ACGT") for _ in range(80)), "x"), (504, "ACG", "x")]
    out = {r.read_id: r for r in map_reads(spark.createDataFrame(reads, "read_id bigint, seq string, chr string"), spark.createDataFrame(contigs, "name string, seq string")).collect()}
    assert len(out) == len(reads)
    for i, want in truth.items():
        assert (out[i].chr, out[i].strand, out[i].start_pos, out[i].num_mismatches) == want and out[i].alignment_state == "U"
    assert all(out[i].chr == "*" and out[i].alignment_state == "N" for i in range(500, 505))


def test_adapter_is_cut_from_both_mates(spark):
    rng = random.Random(3)
    adapter = "CTGCTGTACCCTACATCCGCCTTGGCCGTACAGCAG"
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    rows = [(1, dna(30) + adapter, dna(25) + adapter + "ACGT"), (2, dna(10) + adapter, dna(30) + adapter), (3, dna(60), dna(30) + adapter), (4, None, dna(30) + adapter), (5, dna(40) + adapter[:12] + "A" + adapter[13:], dna(22) + reverse_complement(adapter))]
    out = {r.id: (r.cut_1, r.cut_2) for r in trim_adapter(spark.createDataFrame(rows, "id int, seq_1 string, seq_2 string"), adapter).collect()}
    assert out == {1: (30, 25), 5: (40, 22)}


def test_sampled_places_and_search_both_ways():
    rng = random.Random(31)
    text = "".join(rng.choice("ACGT") for _ in range(300)) + "ACACACACAC" * 3
    index, both = FMIndex(text, sample=16), BidirectionalIndex(text, sample=7)
    assert sorted(index.sa.tolist()) == list(range(len(text) + 1)) and len(index.places) < 30
    for _ in range(200):
        a = rng.randrange(len(text) - 12)
        pattern = text[a : a + rng.randrange(1, 12)] if rng.random() < 0.8 else "".join(rng.choice("ACGT") for _ in range(6))
        want = [i for i in range(len(text) - len(pattern) + 1) if text.startswith(pattern, i)]
        assert index.search(pattern) == want
        assert both.search(pattern, rng.randrange(len(pattern))) == want


def test_index_of_a_text_is_written_and_read(spark, tmp_path):
    rng = random.Random(32)
    text = [0] + [ord(rng.choice("ACGT")) for _ in range(700)] + [ord(c) for c in "ACGTTGCA" * 40]
    text = text[1:] + text[:1]
    n = len(text)
    letters = spark.createDataFrame(list(enumerate(text)), "pos bigint, letter int")
    write_index(str(tmp_path / "forward"), letters, n, step=16, sample=4)
    read = lambda name: spark.read.parquet(str(tmp_path / "forward" / name)).collect()
    sa = sorted(range(n), key=lambda p: text[p:] + text[:p])
    assert {r.i: r.pos for r in read("places")} == {i: p for i, p in enumerate(sa) if i % 4 == 0}
    bwt = [text[p - 1] for p in sa]
    assert {r.i: r.letter for r in read("bwt")} == dict(enumerate(bwt))
    assert {(r.block, r.letter): r.occ for r in read("occurrences")} == {(b, c): bwt[: 16 * b].count(c) for b in range(-(-n // 16)) for c in set(text)}
    assert {r.letter: r.smaller for r in read("smaller")} == {c: sum(x < c for x in text) for c in set(text)}


def test_index_set_holds_both_directions(spark, tmp_path):
    rows = [(2, "b", "GATTACA"), (1, "a", "ACGTNACGT"), (3, "c", None), (4, "d", "CC")]
    write_index_set(str(tmp_path), spark.createDataFrame(rows, "id int, name string, seq string"), "name", "id", "seq", step=4, sample=1)
    text = "ACGTNACGTGATTACACCN"  # 18 letters, one to make the whole even
    assert {(r["name"], r.length, r.offset) for r in spark.read.parquet(f"{tmp_path}/sequences").collect()} == {("a", 9, 0), ("b", 7, 9), ("c", 0, 16), ("d", 2, 16)}
    for folder, t in (("forward", text), ("reverse", text[::-1])):
        closed = t + "$"
        want = sorted(range(len(closed)), key=lambda p: closed[p:])
        assert [r.pos for r in spark.read.parquet(f"{tmp_path}/{folder}/places").orderBy("i").collect()] == want


def test_quick_scan_by_the_index_equals_the_text():
    rng = random.Random(33)
    text = "".join(rng.choice("ACGT") for _ in range(120))
    for _ in range(60):
        read = "".join(rng.choice("ACGTN") for _ in range(rng.randrange(30))) + text[40 : 40 + rng.randrange(20)]
        breaks, start = [], 0
        for at in range(len(read)):
            if read[start : at + 1] not in text:
                breaks.append(at)
                start = at + 1
        assert FMIndex(text).longest_segments(read)[:2] == (len(breaks), breaks)


def test_only_strands_that_cannot_stand_are_passed_over(monkeypatch):
    from lociframe.operators import kernels

    rng = random.Random(26)
    asked, cases = [], []
    for _ in range(3000):
        window = "".join(rng.choice("ACGTN" if rng.random() < 0.1 else "ACGT") for _ in range(rng.randrange(10, 120)))
        n, at = rng.randrange(1, 40), rng.randrange(len(window))
        letters = list(window[at : at + n] + window[: rng.randrange(8)])
        for _ in range(rng.randrange(5)):
            letters[(p := rng.randrange(len(letters))) : p + 1] = rng.choice([["A"], ["N"], [], ["C", "G"]])
            letters = letters or ["A"]
        cases.append(("".join(letters), window, rng.randrange(4)))
    fast = [map_in_window(*x) for x in cases]
    monkeypatch.setattr(kernels, "_may_stand", lambda *x: asked.append(x) or True)
    assert fast == [map_in_window(*x) for x in cases] and any(fast) and asked
    for seq, window, k in cases:
        ends = [max(n for n in range(len(seq)) if f(n) in window) for f in (lambda n: seq[:n], lambda n: seq[len(seq) - n :])]
        assert ends == [kernels._longest(lambda n: f(n) in window, len(seq) - 1) for f in (lambda n: seq[:n], lambda n: seq[len(seq) - n :])]


@pytest.mark.parametrize("scores", [None, Scores(gap_open=5, gap_extend=2), Scores(match=2, mismatch=1, gap_open=1, gap_extend=3), Scores(gap_open=2, gap_extend=0), Scores(bisulfite=1), Scores(match=400, mismatch=300, gap_open=900, gap_extend=100)])
def test_scores_of_many_pairs_are_those_of_local_align(scores):
    from lociframe.operators.kernels import local_alignments, local_scores

    rng = random.Random(28)
    windows = ["".join(rng.choice("ACGTN" if i % 3 else "AC") for _ in range(rng.randrange(60))) for i in range(300)]
    queries = ["".join(c for c in w[rng.randrange(len(w) + 1) :] + w[:5] if rng.random() < 0.95) for w in windows]
    one = [local_align(w, q, scores) if w and q else None for w, q in zip(windows, queries)]
    assert local_alignments(windows, queries, scores) == one
    assert local_scores(windows, queries, scores).tolist() == [a.score if a else 0 for a in one] and any(one)
