"""3. Best-fit packing: bin completion with branch and bound over blocks of document pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common, tokenizer

CAPACITY = 2048
#: Pieces that are packed together; blocks are packed independently of each other.
BLOCK = 512
#: Fillings that the search of one block may look at, dominated ones too; then the incumbent, a whole packing, stands.
NODES = 1000
SCHEMA = "doc_id bigint, piece int, first_token bigint, n_tokens int, bin string, bin_offset int, bin_used int"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece into the fullest bin with room. Positions into ``sizes`` (descending)."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
    bins: list[list[int]] = []
    rooms = np.zeros(capacity + 2, bool)
    for i, size in enumerate(sizes):
        room = size + int(np.argmax(rooms[size:]))
        if room <= capacity and rooms[room]:
            b = by_room[room].pop()
            rooms[room] = bool(by_room[room])
        else:
            b, room = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        by_room[room - size].append(b)
        rooms[room - size] = room - size > 0
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Bins that any packing needs: by volume, and by pieces over half a bin with what cannot join them (L2)."""
    best = -(-sum(sizes) // capacity)
    total = np.concatenate([[0], np.cumsum(sizes)])  # descending
    arr = -np.asarray(sizes)
    for cut in sorted({s for s in sizes if s <= capacity // 2}):
        big = int(np.searchsorted(arr, -(capacity - cut), "left"))  # > capacity - cut
        half = int(np.searchsorted(arr, -(capacity / 2), "left"))  # > capacity / 2
        small = int(np.searchsorted(arr, -cut, "right"))  # >= cut
        room = (half - big) * capacity - (total[half] - total[big])
        rest = total[small] - total[half] - room
        best = max(best, half + max(0, -(-int(rest) // capacity)))
    return max(best, int(np.searchsorted(arr, -(capacity / 2), "left")))


def undominated(taken: list[int], free: list[int], left: int) -> bool:
    """Whether no piece left out (``free``) can be added, or take the place of some members, without overflow.

    The members that a piece replaces add up to at most its size and to ``left`` less than it at least: what they leave
    behind fits wherever the piece would have gone. A piece in place of an equal one changes nothing. Sums of members
    are bits of an integer, those of two members or more in a second one.
    """
    every, several = 1, 0
    for v in taken:
        several |= several << v | (every & ~1) << v
        every |= every << v
    for v in free:
        if v <= left or (every >> (v - left)) & ((1 << left) - 1) or several >> v & 1:
            return False
    return True


def fillings(values: list[int], counts: list[int], room: int, waste: int, budget: list[int] | None = None) -> Iterator[tuple[int, ...]]:
    """Undominated sets of pieces for ``room`` that leave at most ``waste`` of it, lazily, best fit first.

    ``values`` are the distinct sizes, descending, ``counts`` how many of each there are; dominated is what
    :func:`undominated` refuses. Each set that is looked at takes one from ``budget[0]``; at nothing there are no more.
    ``reach[k]`` has a bit for every sum that the values from ``k`` on can make, so no branch is a dead end.
    """
    keep, reach = (1 << (room + 1)) - 1, [1]
    for v, c in zip(reversed(values), reversed(counts)):
        r = reach[-1]
        for _ in range(min(c, room // v)):
            r |= (r << v) & keep
        reach.append(r)
    reach.reverse()

    def exact(left: int) -> Iterator[list[int]]:
        stack = [(0, left, ())]
        while stack:
            k, rest, taken = stack.pop()
            while rest and values[k] > rest:
                k += 1
            if not rest:
                yield list(taken)
                continue
            v = values[k]
            for n in range(min(counts[k], rest // v) + 1):  # most of the largest first: it is popped first
                if reach[k + 1] >> (rest - n * v) & 1:
                    stack.append((k + 1, rest - n * v, taken + (v,) * n))

    for left in range(min(waste, room) + 1):
        if reach[0] >> (room - left) & 1:
            for taken in exact(room - left):
                if budget is not None:
                    if budget[0] <= 0:
                        return
                    budget[0] -= 1
                used: dict[int, int] = {}
                for v in taken:
                    used[v] = used.get(v, 0) + 1
                if undominated(taken, [v for v, c in zip(values, counts) if c > used.get(v, 0)], left):
                    yield tuple(taken)


def complete(sizes: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> list[list[int]]:
    """Pack ``sizes`` (descending) into the fewest bins that the search finds; positions by bin.

    The incumbent is best-fit decreasing. Unless it meets the lower bound, bins are completed depth first:
    the largest piece left, with each undominated filling of its bin in best-fit order; a branch ends when its
    waste exceeds what an improvement can afford. Every better packing becomes the incumbent.
    """
    best = best_fit(sizes, capacity)
    low = lower_bound(sizes, capacity)
    if len(best) <= low or not sizes:
        return best
    total, budget = sum(sizes), [nodes]
    have: dict[int, int] = {}
    for s in sizes:
        have[s] = have.get(s, 0) + 1
    found: list[tuple[int, ...]] | None = None
    target = len(best) - 1
    stack: list[Iterator[tuple[int, ...]]] = []
    chosen: list[tuple[int, ...]] = []
    waste = 0

    def branch() -> Iterator[tuple[int, ...]]:
        values = sorted((v for v, c in have.items() if c), reverse=True)
        head = values[0]
        counts = [have[v] - (v == head) for v in values]
        pairs = [(v, c) for v, c in zip(values, counts) if c]
        allowed = target * capacity - total - waste
        return ((head, *f) for f in fillings([v for v, _ in pairs], [c for _, c in pairs], capacity - head, allowed, budget))

    stack.append(branch())
    while stack and budget[0] > 0:
        step = next(stack[-1], None)
        budget[0] -= step is None
        if step is None:
            stack.pop()
            if chosen:
                last = chosen.pop()
                waste -= capacity - sum(last)
                for v in last:
                    have[v] += 1
            continue
        waste += capacity - sum(step)
        for v in step:
            have[v] -= 1
        chosen.append(step)
        if sum(have.values()) == 0:
            found = list(chosen)
            target = len(found) - 1
            if len(found) <= low:
                break
            stack.append(iter(()))
        elif waste > target * capacity - total or len(chosen) >= target:
            stack.append(iter(()))
        else:
            stack.append(branch())
    if found is None:
        return best
    where: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        where.setdefault(sizes[i], []).append(i)
    return [[where[v].pop() for v in b] for b in found]


def pack(docs: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, nodes: int = NODES, vocab: str = tokenizer.DEFAULT_VOCAB) -> DataFrame:
    """Pack every token of every document into bins of ``capacity`` tokens.

    A document longer than a bin is cut into full pieces and a rest (``piece``, ``first_token``); full pieces
    are bins of their own. The other pieces of a task are taken in order in blocks of ``block`` and each block
    is packed by :func:`complete`. A row says which ``bin`` a piece is in, from which place on, and how full the
    bin is. No shuffle: bins never cross tasks, which costs at most one part-filled block a task.

    Nulls: a null or empty text has no tokens and one row with piece 0, ``n_tokens`` 0 and no bin.
    A null doc_id is packed like any other; repeated rows are packed as often as they occur. Pieces of equal size stay
    in their order. An empty table gives no rows. A very long text has many full pieces, and costs its own size in memory.
    """

    def emit(ids: list, rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 7
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "first_token", "n_tokens", "bin", "bin_offset", "bin_used"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held = TaskContext.get().partitionId(), 0, []

        def packed(pieces: list[tuple]) -> list[tuple]:
            nonlocal made
            pieces = sorted(pieces, key=lambda p: -p[3])
            rows = []
            for members in complete([p[3] for p in pieces], capacity, nodes):
                name, at, used = f"{task}-{made}", 0, sum(pieces[i][3] for i in members)
                made += 1
                for i in members:
                    rows.append((*pieces[i], name, at, used))
                    at += pieces[i][3]
            return rows

        for batch in common.pieces(batches):
            rows: list[tuple] = []
            for doc, n in zip(batch.column("doc_id").to_pylist(), tokenizer.token_counts(batch.column("text"), vocab).tolist()):
                if not n:
                    rows.append((doc, 0, 0, 0, None, None, None))
                for k in range(n // capacity):
                    rows.append((doc, k, k * capacity, capacity, f"{task}-{made}", 0, capacity))
                    made += 1
                if n % capacity:
                    held.append((doc, n // capacity, n - n % capacity, n % capacity))
            while len(held) >= block:
                rows += packed(held[:block])
                held = held[block:]
            yield emit([], rows)
        if held:
            yield emit([], packed(held))

    return common.mapped(common.project(docs), run, SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
