"""Filling fixed-capacity containers by minimum bin slack.

Items are packed where they are read: every task packs its rows in chunks of ``CHUNK`` items, so no text
and no group is moved. Within a chunk, each container starts with the largest item left, and a bitset
subset-sum over the lengths available finds the fullest combination that still fits. Containers that
stay too empty are taken apart, their items (only ids and lengths) meet the leftovers of other tasks, and
are packed once more.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.tokens import TOKENIZER, token_counts
from lociframe.session import cut_lineage

CHUNK = 4096
FULL_ENOUGH = 0.995
LEFTOVERS_PER_TASK = 32

_SCHEMA = "container_id string, doc_id bigint, piece_no int, token_start bigint, token_end bigint"


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, each of at most ``capacity``; every length must lie in 0..capacity."""
    waiting: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        waiting[lengths[i]].append(i)
    empty = waiting.pop(0, [])
    sizes = sorted(waiting, reverse=True)
    bins: list[list[int]] = []
    while sizes:
        take = [sizes[0]]
        room = capacity - sizes[0]
        if room:
            reach, mask, steps = 1, (1 << (room + 1)) - 1, []
            for size in sizes:
                if size > room:
                    continue
                for _ in range(min(len(waiting[size]) - (size == sizes[0]), room // size)):
                    more = (reach | (reach << size)) & mask
                    if more == reach:
                        break
                    steps.append((size, reach))
                    reach = more
                if reach >> room & 1:
                    break
            left = reach.bit_length() - 1
            for size, before in reversed(steps):
                if not before >> left & 1:
                    take.append(size)
                    left -= size
        bins.append([waiting[size].pop() for size in take])
        if not all(waiting[size] for size in take):
            sizes = [size for size in sizes if waiting[size]]
    if empty:
        (bins[-1] if bins else bins.append([]) or bins[-1]).extend(reversed(empty))
    return bins


def _packed(items: list[tuple], capacity: int, label: str, final: bool) -> pa.RecordBatch:
    """``items`` are (id, piece, from, to); container null where the items go on to the next round."""
    names, order = [], []
    for n, members in enumerate(pack([t - f for _, _, f, t in items], capacity)):
        filled = sum(items[i][3] - items[i][2] for i in members)
        done = final or filled >= FULL_ENOUGH * capacity
        names += [f"{label}-{n}" if done else None] * len(members)
        order += members
    columns = list(zip(*[items[i] for i in order])) or [(), (), (), ()]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
        names=["container_id", "doc_id", "piece_no", "token_start", "token_end"],
    )


def fill_containers(df: DataFrame, capacity: int, id_col: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Assign every item to a container: ``container_id``, ``doc_id``, ``piece_no``, ``token_start``,
    ``token_end`` (half-open token numbers).

    An item over ``capacity`` becomes pieces of exactly ``capacity`` tokens and one of the rest; no other
    item is split. Null and empty texts take no room and sit in some container, so every row comes
    back; rows that repeat an id are items of their own. An empty table gives no container.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, chunk, items, whole = TaskContext.get().partitionId(), 0, [], []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 256):
                counts = token_counts(batch.column(1).slice(at, 256).to_pylist(), tokenizer)
                for doc, n in zip(ids[at : at + 256], counts):
                    cut = (n // capacity) * capacity if n > capacity else 0
                    whole += [(doc, k, k * capacity, (k + 1) * capacity) for k in range(cut // capacity)]
                    if n > cut or n == 0:
                        items.append((doc, cut // capacity, cut, n))
                if len(items) + len(whole) >= CHUNK:
                    yield _packed(items + whole, capacity, f"a-{part}-{chunk}", False)
                    chunk, items, whole = chunk + 1, [], []
        if items or whole:
            yield _packed(items + whole, capacity, f"a-{part}-{chunk}", False)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, chunk, items = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            items += list(zip(*[batch.column(i).to_pylist() for i in range(1, 5)]))
            while len(items) >= 4 * CHUNK:
                yield _packed(items[: 4 * CHUNK], capacity, f"b-{part}-{chunk}", True)
                chunk, items = chunk + 1, items[4 * CHUNK :]
        if items:
            yield _packed(items, capacity, f"b-{part}-{chunk}", True)

    source = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    tasks = max(1, source.rdd.getNumPartitions() // LEFTOVERS_PER_TASK)
    packed = cut_lineage(source.mapInArrow(first, _SCHEMA))  # both uses below see the same assignment
    left = packed.filter("container_id is null").repartition(tasks, "doc_id").sortWithinPartitions("doc_id", "piece_no", "token_end")
    return packed.filter("container_id is not null").unionByName(left.mapInArrow(again, _SCHEMA))
