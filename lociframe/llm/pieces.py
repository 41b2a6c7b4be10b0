"""Cutting oversized sequences at runs of unknown bases, into balanced, overlapping pieces.

The smallest possible number of pieces sets equally spaced targets. Each target moves to the strongest
(longest, then nearest) boundary around it; where there is none, it stays. If a piece is then over the
limit, or more cuts are forced than must be, one piece more is tried, up to the number that cuts at the furthest
boundaries make. Where even that does not do, targets are left aside: of all cuts with the fewest forced ones and then
the fewest pieces, those with the least sum of squared lengths are taken, which are the most balanced ones.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_RUN = 10


def cut_kind(cuts: list[tuple[int, bool]], length: int, runs: list[tuple[int, int]], limit: int) -> str:
    """``forced`` if a cut had to be made inside a stretch between boundaries, or ends, that is itself over the limit,
    else ``natural``. Pieces within the limit cut every such stretch."""
    ends, starts = [0, *[b for _, b in runs]], [*[a for a, _ in runs], length]
    for at, natural in cuts:
        k = bisect_left(ends, at) - 1
        if not natural and ends[k] < at < starts[k] and starts[k] - ends[k] > limit:
            return "forced"
    return "natural"


def furthest_cuts(length: int, runs: list[tuple[int, int]], limit: int, overlap: int) -> list[tuple[int, bool]]:
    """Cuts (position, at a boundary), each as far as it goes. No cuts have fewer forced ones: what can be
    reached from a place can be reached or has been passed from any later place."""
    starts, cuts, begin = [a for a, _ in runs], [], 0
    while begin + limit < length:
        far = begin + limit
        k = bisect_right(starts, far) - 1
        at = min(runs[k][1], far) if k >= 0 else -1
        natural = at - overlap > begin
        cuts.append((at if natural else far, natural))
        begin = cuts[-1][0] - overlap
    return cuts


def most_balanced_cuts(length: int, runs: list[tuple[int, int]], limit: int, overlap: int) -> list[tuple[int, bool]]:
    """Cuts with the fewest forced ones, then the fewest pieces, then the least sum of squared lengths, over paths
    from boundary to boundary. Cuts forced between two boundaries are spaced equally."""
    stride = limit - overlap
    nodes = sorted({p for a, b in runs for p in (*range(a, b, max(1, stride // 2)), b) if 0 < p < length})
    nodes = [0, *nodes, length]
    best: list[tuple | None] = [(0, 0, 0, None)] + [None] * (len(nodes) - 1)
    for i, at in enumerate(nodes[:-1]):
        if best[i] is None:
            continue
        begin = max(0, at - overlap)
        low = bisect_right(nodes, max(at, begin + overlap), i + 1)
        high = bisect_right(nodes, begin + limit)
        if low >= high:  # no boundary in reach: all those behind the fewest forced cuts
            high = bisect_right(nodes, begin + limit + stride * -(-(nodes[low] - begin - limit) // stride))
        for j in range(low, high):
            n = max(1, -(-(nodes[j] - begin - overlap) // stride))
            squares = (nodes[j] - begin + (n - 1) * overlap) ** 2 // n
            state = (best[i][0] + n - 1, best[i][1] + n, best[i][2] + squares, i)
            if best[j] is None or state < best[j]:
                best[j] = state
    cuts, j = [], len(nodes) - 1
    while j:
        i = best[j][3]
        begin = max(0, nodes[i] - overlap)
        n = best[j][1] - best[i][1]
        step = (nodes[j] - begin - overlap) / n
        cuts += [(nodes[j], True)] * (j < len(nodes) - 1) + [(begin + overlap + round(k * step), False) for k in range(n - 1, 0, -1)]
        j = i
    cuts, starts, begin = cuts[::-1], [a for a, _ in runs], 0
    for c, (at, natural) in enumerate(cuts):  # a run goes to the piece before it as far as the limit lets it
        end = min(runs[bisect_right(starts, at) - 1][1], begin + limit) if natural else at
        if end < (cuts[c + 1][0] if c + 1 < len(cuts) else length):
            cuts[c] = at, natural = max(at, end), natural
        begin = at - overlap
    return cuts


def balanced_cuts(length: int, runs: list[tuple[int, int]], limit: int, overlap: int) -> list[tuple[int, bool]]:
    """Ends of all pieces but the last (position, at a boundary); the next piece starts ``overlap`` before an end."""
    if length <= limit:
        return []
    least = -(-(length - overlap) // (limit - overlap))
    furthest = furthest_cuts(length, runs, limit, overlap)
    unavoidable = sum(not natural for _, natural in furthest)
    middles = [(a + b) // 2 for a, b in runs]
    for n in range(least, len(furthest) + 2):
        step, cuts, begin = length / n, [], 0
        for j in range(1, n):
            target = round(j * step)
            low, high = max(begin + overlap + 1, target - int(step / 2)), min(begin + limit, target + int(step / 2))
            near = range(max(0, bisect_left(middles, low)), bisect_right(middles, high))
            best = max(near, key=lambda k: (runs[k][1] - runs[k][0], -abs(middles[k] - target)), default=None)
            cuts.append((min(runs[best][1], begin + limit), True) if best is not None else (target, False))
            if not begin + overlap < cuts[-1][0] <= begin + limit:
                break
            begin = cuts[-1][0] - overlap
        else:
            if length - begin <= limit and sum(not natural for _, natural in cuts) <= unavoidable:
                return cuts
    return most_balanced_cuts(length, runs, limit, overlap)


def split_sequences(df: DataFrame, limit: int, overlap: int, id_col: str = "seq_id", name: str = "name", seq: str = "seq") -> DataFrame:
    """Pieces of every sequence: ``seq_id``, ``piece_name``, ``piece_no`` from 1, ``piece_start``,
    ``piece_end`` (0-based half-open, white space not counted), ``cut_kind``, ``ends_at`` and ``piece``.

    ``cut_kind`` is null for sequences within the limit, which are their own only piece, else ``forced``
    or ``natural``; ``ends_at`` is boundary, forced or end. A piece is named after the sequence and its
    1-based place; a null name counts as the id. Null sequences have no row, empty ones one empty piece.
    Rows that repeat an id are cut each by itself.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    run = re.compile(rf"[Nn]{{{MIN_RUN},}}")
    names = ["seq_id", "piece_name", "piece_no", "piece_start", "piece_end", "cut_kind", "ends_at", "piece"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, letters = [], 0
            for key, label, text in zip(*[c.to_pylist() for c in batch.columns]):
                runs = [m.span() for m in run.finditer(text)] if len(text) > limit else []
                cuts = balanced_cuts(len(text), runs, limit, overlap)
                kind = cut_kind(cuts, len(text), runs, limit) if cuts else None
                ends = [*cuts, (len(text), None)]
                begin = 0
                for k, (end, natural) in enumerate(ends, 1):
                    rows.append((key, f"{label}:{begin + 1}-{end}", k, begin, end, kind, {True: "boundary", False: "forced", None: "end"}[natural], text[begin:end]))
                    begin = end - overlap
                letters += len(text)
                if letters > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows, letters = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    plain = df.filter(F.col(seq).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(F.col(name), F.col(id_col).cast("string")).alias("name"),
        F.regexp_replace(F.col(seq), r"[\s\p{Z}]+", "").alias("seq"),
    )
    return plain.mapInArrow(cut, "seq_id bigint, piece_name string, piece_no int, piece_start int, piece_end int, cut_kind string, ends_at string, piece string")
