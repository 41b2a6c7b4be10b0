"""Pairwise alignment kernels. They run inside Arrow batches on one short query and one window each."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np

_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def reverse_complement(seq: str) -> str:
    return seq.translate(_COMPLEMENT)[::-1]


@dataclass
class Scores:
    """Match score, penalties, band width; ``bisulfite`` forgives a T read on a C."""

    # The default scores.
    match: int = 1
    mismatch: int = 3
    gap_open: int = 11
    gap_extend: int = 4
    split: int = 11
    band: int = 31
    bisulfite: int | None = None


@dataclass
class Alignment:
    cigar: str
    score: int
    differences: int
    position: int
    """0-based start in the window."""
    ops: list[tuple[str, int]] = field(default_factory=list)
    raw: int = 0
    """Edit distance before ends are clipped."""


def runs(ops: str) -> list[tuple[str, int]]:
    return [(op, sum(1 for _ in same)) for op, same in groupby(ops)]


def cigar_of(ops: str) -> str:
    return "".join(f"{n}{op}" for op, n in runs(ops))


def local_align(window: str, query: str, scores: Scores | None = None, banded: bool = False) -> Alignment | None:
    """Best local alignment with affine gaps; N matches everything; None without a positive score.

    Of equally good ends the first (upper row, left column) is taken; on the way back a diagonal comes
    before an insertion, an insertion before a deletion.
    """
    s = scores or Scores()
    low = -(10**9)
    n = len(window)
    best, at = 0, (0, 0)
    above, above_ins = [0] * (n + 1), [low] * (n + 1)
    trace: list[bytearray] = [bytearray(n + 1)]
    for i, q in enumerate(query, 1):
        row, ins, deletion = [0] * (n + 1), [low] * (n + 1), low
        steps = bytearray(n + 1)
        first, last = (max(1, i - s.band // 2), n if i == 1 else min(n, i + s.band - s.band // 2)) if banded else (1, n)
        for j in range(first, last + 1):
            r = window[j - 1]
            if r == q or r == "N" or q == "N":
                gain = s.match
            else:
                gain = -s.bisulfite if s.bisulfite is not None and r == "C" and q == "T" else -s.mismatch
            open_i, more_i = above[j] - s.gap_open, above_ins[j] - s.gap_extend
            open_d, more_d = row[j - 1] - s.gap_open, deletion - s.gap_extend
            ins[j], deletion = max(open_i, more_i), max(open_d, more_d)
            diagonal = above[j - 1] + gain
            value = max(diagonal, ins[j], deletion)
            code = (4 if more_i > open_i else 0) | (8 if more_d > open_d else 0)
            if value > 0:
                row[j] = value
                code |= 1 if diagonal == value else 2 if ins[j] == value else 3
                if value > best:
                    best, at = value, (i, j)
            steps[j] = code
        trace.append(steps)
        above, above_ins = row, ins
    if not best:
        return None
    i, j = at
    out = ["S" * (len(query) - i)]
    differences, gap = 0, ""
    while i and j:
        step = trace[i][j]
        move = gap or {0: "", 1: "M", 2: "I", 3: "D"}[step & 3]
        if not move:
            break
        if move == "M":
            r, q = window[j - 1], query[i - 1]
            same = r == q or "N" in (r, q)
            out.append("M" if same else "X")
            differences += not same
            i, j = i - 1, j - 1
        elif move == "I":
            gap = "I" if step & 4 else ""
            out.append("I")
            differences, i = differences + 1, i - 1
        else:
            gap = "D" if step & 8 else ""
            out.append("D")
            differences, j = differences + 1, j - 1
    out.append("S" * i)
    ops = "".join(reversed(out))
    return Alignment(cigar_of(ops), best, differences, j, runs(ops))


_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[[ord(c) for c in "ACGTN"]] = [1, 2, 4, 8, 15]
BLOCK_CELLS = 1 << 16
TRACE_CELLS = 1 << 23


def _block(texts: list[str]) -> np.ndarray:
    """Letters of the texts as sets of bases, a text a column, with 0 after the end of each."""
    width = max(map(len, texts))
    flat = np.frombuffer("".join(t.ljust(width) for t in texts).encode("latin-1", "replace"), dtype=np.uint8)
    return np.ascontiguousarray(_LETTER[flat].reshape(len(texts), width).T)


def _blocks(windows: list[str], queries: list[str], cells: int, trace: bool) -> Iterator[list[int]]:
    """Places of pairs of like sizes, both not empty."""
    order = sorted((i for i in range(len(queries)) if queries[i] and windows[i]), key=lambda i: (len(queries[i]), len(windows[i])))
    low = 0
    while low < len(order):
        size = len(queries[order[low]])
        high = min(len(order), low + max(16, min(2048, cells // (size * (size + len(windows[order[low]])) if trace else size))))
        yield order[low:high]
        low = high


def _plain(s: Scores) -> bool:
    return s.bisulfite is None and min(s.match, s.mismatch, s.gap_open, s.gap_extend) >= 0


def local_scores(windows: list[str], queries: list[str], scores: Scores | None = None) -> np.ndarray:
    """The score of :func:`local_align` of each query in its own window, 0 where that is None: many pairs at once, of letters
    A, C, G, T and N.

    The matrices of pairs of like sizes are filled together, one diagonal after the other.
    """
    s = scores or Scores()
    if not _plain(s):
        return np.array([a.score if a else 0 for a in local_alignments(windows, queries, s)], dtype=np.int64)
    out = np.zeros(len(queries), dtype=np.int64)
    for some in _blocks(windows, queries, BLOCK_CELLS, False):
        out[some] = _diagonals(_block([windows[i] for i in some]), _block([queries[i] for i in some]), s)[0].max(axis=0)
    return out


def local_alignments(windows: list[str], queries: list[str], scores: Scores | None = None) -> list[Alignment | None]:
    """:func:`local_align` of each query in its own window, many pairs at once, of letters A, C, G, T and N."""
    s = scores or Scores()
    if not _plain(s):
        return [local_align(w, q, s) if w and q else None for w, q in zip(windows, queries)]
    out: list[Alignment | None] = [None] * len(queries)
    for some in _blocks(windows, queries, TRACE_CELLS, True):
        window, query = _block([windows[i] for i in some]), _block([queries[i] for i in some])
        trace = np.zeros((len(window) + len(query) + 1, len(query) + 1, len(some)), dtype=np.uint8)
        best, first = _diagonals(window, query, s, trace)
        end, column = best.argmax(axis=0), np.arange(len(some))
        score = best[end, column]
        i, j = end.copy(), first[end, column] - end
        live, gap, steps = score > 0, np.zeros(len(some), dtype=np.uint8), []
        while (live := live & (i > 0) & (j > 0)).any():
            code = trace[i + j, i, column]
            move = np.where(gap > 0, gap, code & 3)
            live &= move > 0
            same = (query[i - 1, column] & window[j - 1, column]) != 0
            steps.append(np.where(live, np.choose(move, [0, np.where(same, ord("M"), ord("X")), ord("I"), ord("D")]), 0).astype(np.uint8))
            gap = np.where((move == 2) & (code & 4 > 0) | (move == 3) & (code & 8 > 0), move, 0).astype(np.uint8)
            i -= live & (move != 3)
            j -= live & (move != 2)
        ways = np.array(steps[::-1], dtype=np.uint8).reshape(len(steps), len(some)).T
        for n, k in enumerate(some):
            if score[n]:
                way = ways[n].tobytes().replace(b"\0", b"").decode()
                ops = "S" * i[n] + way + "S" * (len(queries[k]) - end[n])
                out[k] = Alignment(cigar_of(ops), int(score[n]), len(way) - way.count("M"), int(j[n]), runs(ops))
    return out


def _diagonals(window: np.ndarray, query: np.ndarray, s: Scores, trace: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The best value in each row of each matrix, and the diagonal that first has it. ``trace`` gets the steps of
    :func:`local_align` by diagonal and row; the diagonals of the best values are found only with it."""
    (n, many), m = window.shape, len(query)
    kind = np.int16 if s.match * min(n, m) + s.mismatch + s.gap_open + s.gap_extend < 1 << 14 else np.int64
    window = np.ascontiguousarray(window[::-1])  # along a diagonal the window runs backwards
    none = -s.gap_open - s.gap_extend - 1
    # rows are letters of the query from 1 on; of each diagonal the last values of the matrix and of gaps of either kind
    first, last, this = (np.zeros((m + 1, many), dtype=kind) for _ in range(3))
    ins, ins_next, deletion = (np.full((m + 1, many), none, dtype=kind) for _ in range(3))
    where = np.zeros((m + 1, many), dtype=np.int64)
    best, opened, gain = (np.zeros((m + 1, many), dtype=kind) for _ in range(3))
    for d in range(2, m + n + 1):
        a, b = max(1, d - n), min(m, d - 1) + 1  # cells (i, d - i)
        at, before = slice(a, b), slice(a - 1, b - 1)
        g = gain[at]
        np.multiply((query[a - 1 : b - 1] & window[n - d + a : n - d + b]) != 0, kind(s.match + s.mismatch), out=g)
        g -= kind(s.mismatch)
        g += first[before]
        o = opened[a - 1 : b]
        np.subtract(last[a - 1 : b], kind(s.gap_open), out=o)
        np.subtract(ins[before], kind(s.gap_extend), out=ins_next[at])
        x = deletion[at]
        x -= kind(s.gap_extend)
        if trace is not None:
            code = (ins_next[at] > o[:-1]) * np.uint8(4) | (x > o[1:]) * np.uint8(8)
        np.maximum(ins_next[at], o[:-1], out=ins_next[at])
        np.maximum(x, o[1:], out=x)
        t = this[at]
        np.maximum(g, ins_next[at], out=t)
        np.maximum(t, x, out=t)
        if trace is not None:
            trace[d, at] = code | np.where(t > 0, np.where(g == t, np.uint8(1), np.where(ins_next[at] == t, np.uint8(2), np.uint8(3))), np.uint8(0))
            np.copyto(where[at], d, where=t > best[at])
        np.maximum(t, kind(0), out=t)
        np.maximum(best[at], t, out=best[at])
        first, last, this = last, this, first
        ins, ins_next = ins_next, ins
    return best, where


def _masks(query: str) -> dict[str, int]:
    any_base = sum(1 << i for i, q in enumerate(query) if q == "N")
    return {c: any_base | sum(1 << i for i, q in enumerate(query) if q == c) for c in "ACGT"} | {"N": any_base}


def _columns(window: str, query: str):
    """Vertical deltas of the edit matrix, column by column, on one integer per sign."""
    m = len(query)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks = _masks(query)
    plus, minus, distance = full, 0, m
    for letter in window:
        eq = masks.get(letter, masks["N"])
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        hp, hn = (minus | ~(plus | d0)) & full, plus & d0
        distance += 1 if hp & top else -1 if hn & top else 0
        hp, hn = (hp << 1) & full, (hn << 1) & full
        plus, minus = (hn | ~(d0 | hp)) & full, hp & d0
        yield distance, plus, minus


def edit_distance(window: str, query: str) -> tuple[int, int]:
    """Least edit distance of the query to any part of the window, and the first end (exclusive) that has it."""
    if not query:
        return 0, 0
    best, end = len(query), 0
    for j, (distance, _, _) in enumerate(_columns(window, query), 1):
        if distance < best:
            best, end = distance, j
    return best, end


def edit_align(window: str, query: str, limit: int | None = None, raw_limit: int | None = None) -> Alignment | None:
    """Edit-distance alignment with traceback. Insertions at an end become soft clips, deletions there
    fall away, and neither counts; None if more than ``limit`` differences remain, or if the edit distance with its ends is
    over ``raw_limit``. The score is the query length less the differences."""
    if not query:
        return None
    at = window.find(query) if "N" not in query else -1
    if at >= 0:  # no other alignment is better, and none of these ends before
        return Alignment(f"{len(query)}M", len(query), 0, at, [("M", len(query))])
    columns = list(_columns(window, query))
    best, end = len(query), 0
    for j, (distance, _, _) in enumerate(columns, 1):
        if distance < best:
            best, end = distance, j
    if raw_limit is not None and best > raw_limit:
        return None
    i, j, ops = len(query), end, []
    while i:
        if not j:
            ops.append("I" * i)
            break
        _, plus, minus = columns[j - 1]
        q, bit = query[i - 1], 1 << (i - 1)
        if q == window[j - 1] or q == "N":
            ops.append("M")
            i, j = i - 1, j - 1
        elif plus & bit:
            ops.append("I")
            i -= 1
        elif not minus & bit:
            ops.append("X")
            i, j = i - 1, j - 1
        else:
            ops.append("D")
            j -= 1
    text = "".join(reversed(ops))
    body = text.strip("ID")
    if not body:
        return None
    head, tail = text[: text.index(body)], text[text.index(body) + len(body) :]
    start = j + head.count("D")
    differences = len(body) - body.count("M")
    if limit is not None and differences > limit:
        return None
    shown = "S" * head.count("I") + body.replace("X", "M") + "S" * tail.count("I")
    return Alignment(cigar_of(shown), len(query) - differences, differences, start, runs(shown), best)


@dataclass
class Hit:
    strand: str
    start: int
    """1-based."""
    cigar: str
    differences: int
    score: int
    split: Hit | None = None


def chunk_places(read: str, k: int, least: int = 1) -> tuple[int, list[int]]:
    """Size and starts of k + 1 disjoint chunks without N, as long as they can be; no starts if they would be shorter
    than ``least``."""
    parts = [m.span() for m in re.finditer("[^N]+", read)]
    size = len(read) // (k + 1)
    while size >= least and sum((b - a) // size for a, b in parts) <= k:
        size -= 1
    return size, [a + i * size for a, b in parts for i in range((b - a) // size)][: k + 1] if size >= least else []


def _may_stand(window: str, seq: str, k: int) -> bool:
    """False only if no part of the window is within ``k`` edits of ``seq``: of k + 1 chunks one stands in it unchanged."""
    size, starts = chunk_places(seq, k)
    return not starts or any(seq[a : a + size] in window for a in starts)


def _longest(stands: Callable[[int], bool], most: int) -> int:
    """The greatest n up to ``most`` for which ``stands`` holds, as it then does for all smaller ones."""
    low = 0
    while low < most:
        n = (low + most + 1) // 2
        low, most = (n, most) if stands(n) else (low, n - 1)
    return low


def _span(ops: list[tuple[str, int]], kinds: str) -> int:
    return sum(n for op, n in ops if op in kinds)


def map_in_window(read: str, window: str, k: int, scores: Scores | None = None, min_segment: int = 6) -> list[Hit]:
    """Hits of a read in one window, best first, both strands.

    An exact forward hit keeps the reverse strand from being searched. Otherwise the edit alignment of each
    strand counts if it has at most ``k`` differences once its ends are clipped and still covers half of
    the read. A read whose ends both stand exactly in the window, apart from each other, comes as two
    segments; one whose longest exact end covers half of it comes clipped to that end. So a strand of which neither a
    chunk nor a half stands in the window is not aligned.
    """
    s = scores or Scores()
    found: list[Hit] = []
    for strand, seq in (("+", read), ("-", reverse_complement(read))):
        at = window.find(seq)
        while at >= 0:
            found.append(Hit(strand, at + 1, f"{len(seq)}M", 0, len(seq) * s.match))
            at = window.find(seq, at + 1)
        if found:
            return found
    for strand, seq in (("+", read), ("-", reverse_complement(read))):
        a = edit_align(window, seq) if _may_stand(window, seq, k) else None
        matched = _span(a.ops, "MI") if a else 0
        clipped = len(seq) - matched
        if a and a.raw <= k and a.differences <= k and 2 * matched >= len(seq):
            found.append(Hit(strand, a.position + 1, a.cigar, a.differences, matched * s.match - a.differences * s.mismatch - (s.split if clipped > k else 0)))
            continue
        half = -(-len(seq) // 2)
        if seq[:half] not in window and seq[-half:] not in window:
            continue
        head = _longest(lambda n: seq[:n] in window, len(seq) - 1)
        tail = _longest(lambda n: seq[len(seq) - n :] in window, len(seq) - 1)
        rest = seq[head:]
        if min(head, len(rest)) >= min_segment and rest in window:
            second = Hit(strand, window.find(rest) + 1, f"{len(rest)}M", 0, len(rest) * s.match)
            found.append(Hit(strand, window.find(seq[:head]) + 1, f"{head}M", 0, len(seq) * s.match - s.split, second))
        elif 2 * max(head, tail) >= len(seq):
            if head >= tail:
                found.append(Hit(strand, window.find(seq[:head]) + 1, f"{head}M{len(seq) - head}S", 0, head * s.match - s.split))
            else:
                found.append(Hit(strand, window.find(seq[-tail:]) + 1, f"{len(seq) - tail}S{tail}M", 0, tail * s.match - s.split))
    return sorted(found, key=lambda h: (-h.score, h.differences, h.strand != "+", h.start))
