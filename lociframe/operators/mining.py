"""k-means and X-means as driver loops over DataFrame aggregations; consensus sequences.

Only centroids (K rows) and per-cluster statistics come to the driver. The assignment is one expression
over a literal array of centroids, so no join is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.operators.overlap import concat_offsets
from lociframe.session import cut_lineage

MAX_ROUNDS = 300


# Multiplier, increment and width of the generator.
MULTIPLIER, INCREMENT, WIDTH = 0x5DEECE66D, 0xB, 48


class JavaRandom:
    """The 48-bit linear congruential generator of java.util.Random, for equal starting points."""

    def __init__(self, seed: int = 0):
        self.state = (seed ^ MULTIPLIER) & ((1 << WIDTH) - 1)

    def bits(self, n: int) -> int:
        self.state = (self.state * MULTIPLIER + INCREMENT) & ((1 << WIDTH) - 1)
        value = self.state >> (WIDTH - n)
        return value - (1 << n) if n == 32 and value >> 31 else value

    def below(self, bound: int) -> int:
        if bound & -bound == bound:
            return (bound * self.bits(31)) >> 31
        while True:
            bits = self.bits(31)
            if bits - bits % bound + (bound - 1) < 1 << 31:
                return bits % bound

    def unit(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) / float(1 << 53)


def _squared(point: Column, centroid: list[float]) -> Column:
    return sum(((F.get(point, F.lit(i)) - float(c)) ** 2 for i, c in enumerate(centroid)), F.lit(0.0))


def assign(points: DataFrame, point: str, centroids: list[list[float]]) -> DataFrame:
    """``points`` with ``cluster_id`` and ``squared``: the closest centroid, the lowest number on ties."""
    distances = F.array(*[F.struct(_squared(F.col(point), c).alias("squared"), F.lit(k).alias("cluster_id")) for k, c in enumerate(centroids)])
    return points.withColumn("__near", F.array_min(distances)).withColumns({"cluster_id": F.col("__near.cluster_id"), "squared": F.col("__near.squared")}).drop("__near")


@dataclass
class Cluster:
    n: int
    sse: float
    """Sum of squared distances to the centroid."""
    center: list[float]
    low: list[float]
    high: list[float]


def _statistics(points: DataFrame, point: str, centroids: list[list[float]], inside: list[list[float]] | None = None) -> dict[int, Cluster]:
    """The clusters around ``centroids`` that hold points. With ``inside``, points go to the nearest of these first, and
    then to one of its own centroids, as many for each of ``inside``, one after the other.

    Each task adds up its own points with numpy, so K rows per task and dimension are shuffled. The plan does not depend
    on the centroids, so its code is compiled once for all rounds.
    """
    at = np.array(centroids, dtype=float)
    outer = None if inside is None else np.array(inside, dtype=float)
    own = len(at) // len(inside) if inside else 0

    def nearest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        squared = np.stack([((x - c) ** 2).sum(1) for c in at], axis=1)
        if outer is None:
            near = squared.argmin(1)
        else:
            home = np.stack([((x - c) ** 2).sum(1) for c in outer], axis=1).argmin(1)
            mine = squared[np.arange(len(x))[:, None], home[:, None] * own + np.arange(own)]
            near = home * own + mine.argmin(1)
        return near, squared[np.arange(len(x)), near]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, error, total = np.zeros(len(at), dtype=np.int64), np.zeros(len(at)), np.zeros_like(at)
        low, high = np.full_like(at, np.inf), np.full_like(at, -np.inf)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, at.shape[1])
            for begin in range(0, len(flat), 4096):
                x = flat[begin : begin + 4096]
                near, squared = nearest(x)
                size += np.bincount(near, minlength=len(at))
                error += np.bincount(near, weights=squared, minlength=len(at))
                np.add.at(total, near, x)
                np.minimum.at(low, near, x)
                np.maximum.at(high, near, x)
        lists = [pa.array(x.tolist(), pa.list_(pa.float64())) for x in (total, low, high)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at), dtype=np.int32)), pa.array(size), pa.array(error), *lists], names=["cluster_id", "n", "sse", "total", "low", "high"])

    parts = points.select(point).mapInArrow(add_up, "cluster_id int, n bigint, sse double, total array<double>, low array<double>, high array<double>").filter("n > 0")
    flat = parts.select("cluster_id", "n", "sse", F.posexplode(F.arrays_zip("total", "low", "high")).alias("i", "x"))
    rows = flat.groupBy("cluster_id", "i").agg(F.sum("n").alias("n"), F.sum("sse").alias("sse"), F.sum("x.total").alias("total"), F.min("x.low").alias("low"), F.max("x.high").alias("high")).collect()  # K * dims rows
    found: dict[int, Cluster] = {}
    for r in sorted(rows, key=lambda r: (r.cluster_id, r.i)):
        c = found.setdefault(r.cluster_id, Cluster(r.n, r.sse, [], [], []))
        c.center.append(r.total / r.n)
        c.low.append(r.low)
        c.high.append(r.high)
    return found


def initial_centroids(points: DataFrame, point: str, order: str, k: int, seed: int = 0) -> list[list[float]]:
    """K distinct points drawn by :class:`JavaRandom` from the rows in the order of ``order``.

    Fewer distinct points than ``k`` give that many centroids.
    """
    n = points.count()
    distinct = points.select(point).distinct().limit(k).count()
    random, chosen = JavaRandom(seed), []
    if not n:
        return []
    numbered = cut_lineage(concat_offsets(points.select(order, F.lit(1).alias("__one")), order, "__one").select(order, "offset"))
    while len(chosen) < min(k, distinct):
        at = numbered.filter(F.col("offset") == random.below(n)).select(F.col(order).alias("__at")).first()[0]
        candidate = list(points.filter(F.col(order).eqNullSafe(F.lit(at))).select(point).first()[0])
        if candidate not in chosen:
            chosen.append(candidate)
    return chosen


def k_means(points: DataFrame, point: str, centroids: list[list[float]], max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, list[list[float]]]:
    """Lloyd's iteration from given centroids: the assignment and the centroids it was made with.

    Ends when the mean squared distance no longer falls, when two centroids become equal, or after
    ``max_rounds``. An empty cluster keeps its centroid. Null points are left out; no points give an empty
    assignment.
    """
    points = points.filter(F.col(point).isNotNull())
    written = cut_lineage(points.select(point))  # read in every round
    return assign(points, point, kept := _lloyd(written, point, centroids, max_rounds)), kept


def _lloyd(points: DataFrame, point: str, centroids: list[list[float]], max_rounds: int = MAX_ROUNDS) -> list[list[float]]:
    return _split(points, point, None, [centroids], max_rounds)[0][0]


def _split(points: DataFrame, point: str, inside: list[list[float]] | None, starts: list[list[list[float]]], max_rounds: int = MAX_ROUNDS) -> list[tuple[list[list[float]], list[Cluster]]]:
    """Lloyd's iteration within every cluster of ``inside`` at once, from the starting points of each: the centroids that
    each ended with, and their clusters. One job does a round of all."""
    width = len(starts[0])
    now, last = [list(s) for s in starts], [math.inf] * len(starts)
    kept: list[tuple[list[list[float]], list[Cluster]]] = [(s, []) for s in starts]
    going = set(range(len(starts)))
    for _ in range(max_rounds):
        if not going:
            break
        found = _statistics(points, point, [c for s in now for c in s], inside)
        for k in sorted(going):
            own = {j: found[k * width + j] for j in range(width) if k * width + j in found}
            total = sum(c.n for c in own.values())
            mean = sum(c.sse for c in own.values()) / total if total else 0.0
            if not total or mean >= last[k]:
                going.discard(k)
                continue
            kept[k], last[k] = (now[k], list(own.values())), mean
            now[k] = [own[j].center if j in own else c for j, c in enumerate(now[k])]
            if len({tuple(c) for c in now[k]}) < width:
                going.discard(k)
    return kept


def bic(sizes: list[int], sse: float, dims: int) -> float:
    """Bayesian information criterion of a spherical Gaussian clustering; minus infinity if undefined. The penalty goes by
    the size of each cluster, not by the number of all points."""
    k, r = len(sizes), sum(sizes)
    if r <= k or sse <= 0:
        return -math.inf
    sigma = sse / (r - k)
    parameters = (k - 1) + dims * k + 1
    value = 0.0
    for n in sizes:
        if n:
            value += -n / 2 * math.log(2 * math.pi) - n * dims / 2 * math.log(sigma) - (n - k) / 2 + n * math.log(n) - n * math.log(r) - parameters / 2 * math.log(n)
    return value


def x_means(points: DataFrame, point: str, max_k: int, seed: int = 0) -> tuple[DataFrame, list[list[float]]]:
    """Number of clusters up to ``max_k`` by splitting clusters in two as long as the BIC rises.

    A split starts at half the diagonal of the cluster's bounding box, both ways along a direction drawn
    once from ``seed``, in the plane of the first two coordinates.
    """
    points = points.filter(F.col(point).isNotNull())
    written = cut_lineage(points.select(point))  # read in every round
    first = written.select(F.size(point)).first()
    if first is None:
        return points.withColumns({"cluster_id": F.lit(0), "squared": F.lit(0.0)}), []
    dims = first[0]
    angle = JavaRandom(seed).unit() * math.pi
    value = lambda clusters, k: bic([c.n for c in clusters] + [0] * (k - len(clusters)), sum(c.sse for c in clusters), dims)

    centroids = [_statistics(written, point, [[0.0] * dims])[0].center]
    found = _statistics(written, point, centroids)
    best = value(found.values(), 1)
    while len(centroids) < max_k:
        starts = []
        for k, c in enumerate(centroids):
            own = found.get(k)
            diagonal = math.sqrt(sum((h - l) ** 2 for l, h in zip(own.low, own.high))) if own else 0.0
            shift = ([math.cos(angle) * diagonal / 2, math.sin(angle) * diagonal / 2] + [0.0] * dims)[:dims]
            starts.append([[v + sign * s for v, s in zip(c, shift)] for sign in (1, -1)])
        proposal: list[list[float]] = []
        for k, (halves, clusters) in enumerate(_split(written, point, centroids, starts)):
            own = found.get(k)
            if own is None:
                continue
            single = own.n == 1 or own.low == own.high
            proposal += halves if not single and value(clusters, 2) > value([own], 1) else [centroids[k]]
        unique = list(dict.fromkeys(map(tuple, proposal)))
        moved = _lloyd(written, point, [list(c) for c in unique])
        found_then = _statistics(written, point, moved)
        then = value(found_then.values(), len(moved))
        if then <= best:
            break
        centroids, best, found = moved, then, found_then
    return assign(points, point, centroids), centroids


def consensus(reference: DataFrame, variants: DataFrame, chr_: str = "chr", seq: str = "seq") -> DataFrame:
    """Reference sequences with single-base variants (``chr``, ``pos`` 1-based, ``alt``) written in.

    Variants on unknown names or beyond the end change nothing; of several at one place the greatest alt
    is taken. The variants of a sequence are applied in one pass over its letters.
    """
    single = variants.filter("alt is not null and length(alt) = 1 and pos >= 1").groupBy(F.col("chr").alias("__c"), F.col("pos").cast("int").alias("pos")).agg(F.max("alt").alias("alt"))
    per = single.groupBy("__c").agg(F.array_sort(F.collect_list(F.struct("pos", "alt"))).alias("__v"))  # at most one per base of the sequence
    joined = reference.join(per, F.col(chr_) == F.col("__c"), "left")
    pieces = F.expr(
        f"array_join(zip_with(concat(array(struct(0 as pos, '' as alt)), __k), concat(transform(__k, v -> v.pos), array(length({seq}) + 1)), (a, b) -> concat(a.alt, substring({seq}, a.pos + 1, b - a.pos - 1))), '')"
    )
    return joined.withColumn("__k", F.expr(f"filter(coalesce(__v, cast(array() as array<struct<pos:int,alt:string>>)), v -> v.pos <= length({seq}))")).withColumn("consensus", F.when(F.col(seq).isNotNull(), pieces)).drop("__c", "__v", "__k")
