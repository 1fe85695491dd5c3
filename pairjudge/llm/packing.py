"""Best-fit packing of documents into sequences by bin completion with branch and bound.

A document is its token ids and the end id; one longer than ``CAPACITY`` is cut into pieces of that
size, the last of which may be shorter. How pieces are packed depends on their lengths alone, so the
plan is made from the counts of each length (``CAPACITY`` rows at most, whatever the input) and holds
patterns with a number of repetitions. The plan is then dealt to the pieces by their rank within their
length.

Plan: best-fit decreasing gives the incumbent. While it needs more sequences than the lower bound, bin
completion looks for a plan with one sequence less: around the largest piece left, it enumerates the
undominated fillings, least waste first, drops those that would waste more than such a plan can
afford, and goes back when nothing is left. Fillings are made one by one as they are needed, and nothing ends the search early
but a budget of ``STEPS`` steps of enumeration for each target. What it
finds is the new incumbent; ``search`` tells whether the last plan is proven to need as few sequences as any.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; an empty
table packs nothing; a null doc_id stays null; texts are taken whole; only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairjudge.llm.common import dense_rank, out_batch, slices, strings, written
from pairjudge.llm.tokens import VOCABULARY, document_ids

CAPACITY = 2048
#: Steps of enumeration that the search for one sequence less may take before it keeps its incumbent.
STEPS = 1_000_000

Pattern = tuple[tuple[int, int], ...]  # (length, how many), largest first
Plan = list[tuple[Pattern, int]]  # pattern, sequences that follow it


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: the least number of sequences any plan needs."""
    n, size = np.zeros(capacity + 1, dtype=object), np.arange(capacity + 1).astype(object)
    for s, c in counts.items():
        n[s] = c
    below_n, below_t = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * size))  # lengths under i
    total = int(below_t[-1])
    best = -(-total // capacity)
    half = capacity // 2
    for k in range(1, half + 1):
        large = below_n[-1] - below_n[capacity - k + 1]
        middle = below_n[capacity - k + 1] - below_n[half + 1]
        room = middle * capacity - (below_t[capacity - k + 1] - below_t[half + 1])
        small = below_t[half + 1] - below_t[k]
        best = max(best, int(large + middle + max(0, -(-(small - room) // capacity))))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over counts: equal sequences are handled together."""
    free: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []  # sorted, the keys of free

    def put(room: int, pattern: Pattern, many: int) -> None:
        if room not in free:
            rooms.insert(bisect_right(rooms, room), room)
            free[room] = []
        free[room].append((pattern, many))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        for room in [r for r in rooms if r >= s]:
            if not left:
                break
            each, made = room // s, []
            while left and free[room]:
                pattern, many = free[room].pop()
                full = min(many, left // each)
                if full:
                    made.append((room - each * s, (*pattern, (s, each)), full))
                    left -= full * each
                if full < many and left and left < each:
                    made.append((room - left * s, (*pattern, (s, left)), 1))
                    full, left = full + 1, 0
                if full < many:
                    free[room].append((pattern, many - full))
            if not free[room]:
                del free[room]
                rooms.remove(room)
            for new in made:
                put(*new)
        each = capacity // s
        if left >= each:
            put(capacity - each * s, ((s, each),), left // each)
        if left % each:
            put(capacity - left % each * s, ((s, left % each),), 1)
    return [group for room in rooms for group in free[room]]


def sequences(plan: Plan) -> int:
    return sum(many for _, many in plan)


class Budget:
    """Steps that a search may still take."""

    def __init__(self, steps: int):
        self.left = steps

    def step(self) -> bool:
        self.left -= 1
        return self.left >= 0


def fillings(counts: dict[int, int], largest: int, room: int, least: int, most: int, budget: Budget) -> Iterator[Pattern]:
    """Undominated fillings of ``room`` beside one ``largest`` piece that leave ``least`` to ``most``, larger pieces first; made one by one,
    as they are asked for, and ended early by nothing but the budget. ``counts`` must be the same whenever one is asked for.

    A filling is dominated if a larger piece that is left could stand in place of one of its own, or
    a single piece that is left has the length of two of its own together.
    """
    def held(s: int) -> int:
        return counts.get(s, 0) - (s == largest)

    sizes = array("i", sorted(s for s in counts if s <= room and held(s)))
    below = array("q", accumulate((s * min(held(s), room // s) for s in sizes), initial=0))  # all pieces of the sizes under an index

    def undominated(chosen: Pattern, left: int) -> bool:
        used = dict(chosen)
        for s in used if left else ():
            at = bisect_right(sizes, s)  # larger pieces that would still fit
            while at < len(sizes) and sizes[at] <= s + left:
                if held(sizes[at]) > used.get(sizes[at], 0):
                    return False
                at += 1
        if any(held(s) > used.get(s, 0) for s in sizes[:bisect_right(sizes, left)]):
            return False
        pair = [s for s, n in chosen for _ in range(min(n, 2))]
        return not any(held(a + b) > used.get(a + b, 0) for i, a in enumerate(pair) for b in pair[i + 1:])

    def extend(upto: int, left: int, chosen: Pattern) -> Iterator[Pattern]:
        """Add pieces of the sizes under the index ``upto``."""
        if not budget.step():
            return
        if least <= left <= most and undominated(chosen, left):
            yield chosen
        for at in range(min(upto, bisect_right(sizes, left)) - 1, -1, -1):
            if left - below[at + 1] > most or budget.left <= 0:  # what is smaller cannot fill it
                return
            s = sizes[at]
            for n in range(min(held(s), left // s), 0, -1):
                yield from extend(at, left - n * s, (*chosen, (s, n)))

    return extend(len(sizes), room, ())


def tighter_first(counts: dict[int, int], largest: int, room: int, spare: int, budget: Budget) -> Iterator[Pattern]:
    """Fillings that leave up to ``spare``, in steps of what they leave; later steps are only made if asked for."""
    least = most = 0
    while least <= min(spare, room):
        yield from fillings(counts, largest, room, least, min(most, spare), budget)
        least, most = most + 1, 4 * most + 1


def completion(counts: dict[int, int], capacity: int, target: int, budget: Budget) -> Plan | None:
    """A plan of ``target`` sequences or fewer, or None: there is none, if the budget has anything left, else none was found."""
    affordable = target * capacity - sum(s * c for s, c in counts.items())
    if affordable < 0:
        return None

    left = dict(counts)  # what the plan so far leaves; every step back restores it

    def options(spare: int) -> Iterator[tuple[Pattern, int, int]]:
        largest = max(left)
        for filling in tighter_first(left, largest, capacity - largest, spare, budget):
            need = dict(filling)
            need[largest] = need.get(largest, 0) + 1
            wasted = capacity - sum(s * n for s, n in need.items())
            many = min(left[s] // n for s, n in need.items())
            if wasted:
                many = min(many, spare // wasted)
            pattern = tuple(sorted(need.items(), reverse=True))
            if many:
                yield pattern, many, wasted * many
            if many > 1:  # and once alone, so that every way of going on is there
                yield pattern, 1, wasted

    plan: Plan = []
    stack = [(affordable, options(affordable))] if left else []
    while stack and budget.left > 0:
        spare, more = stack[-1]
        choice = next(more, None)
        if choice is None:
            stack.pop()
            if plan:
                pattern, many = plan.pop()
                for s, n in pattern:
                    left[s] = left.get(s, 0) + n * many
            continue
        pattern, many, lost = choice
        for s, n in pattern:
            left[s] -= n * many
            if not left[s]:
                del left[s]
        plan.append((pattern, many))
        if not left:
            return plan
        stack.append((spare - lost, options(spare - lost)))
    return None if counts else plan


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Plan:
    """Patterns and how many sequences follow each."""
    return search(counts, capacity, steps)[0]


def search(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> tuple[Plan, bool]:
    """The plan, and whether it is proven that no plan needs fewer sequences: it meets the lower bound, or the search for one sequence
    less came to its end within the budget."""
    counts = {s: c for s, c in counts.items() if c}
    least, plan = lower_bound(counts, capacity) if counts else 0, best_fit(counts, capacity)
    while sequences(plan) > least:
        budget = Budget(steps)
        better = completion(counts, capacity, sequences(plan) - 1, budget)
        if better is None:
            return plan, budget.left > 0
        plan = better
    return plan, True


def layout(plan: Plan) -> np.ndarray:
    """Rows (length, first rank, pieces per sequence, first sequence, offset) by length and rank."""
    rows, taken, sequence = [], {}, 0
    for pattern, many in plan:
        offset = 0
        for s, n in pattern:
            rows.append((s, taken.get(s, 0), n, sequence, offset))
            taken[s] = taken.get(s, 0) + n * many
            offset += s * n
        sequence += many
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
PLACE = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def pieces(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of every document: number, first id, length, CRC-32 of the ids."""

    def task(batches):
        for batch in slices(batches):
            cols: dict[str, list] = {f.name: [] for f in PIECES}
            for doc, text in zip(strings(batch.column("doc_id")), strings(batch.column("text"))):
                ids = document_ids(text, vocabulary)
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start:start + capacity]
                    cols["doc_id"].append(doc)
                    cols["piece"].append(k)
                    cols["start"].append(start)
                    cols["length"].append(len(part))
                    cols["ids_crc32"].append(zlib.crc32(part.tobytes()))
            yield out_batch(PIECES, cols)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, PIECES)


def pack(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece, with its sequence and its place there."""
    spark = documents.sparkSession
    cut = written(pieces(documents, capacity, vocabulary).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    places = spark.sparkContext.broadcast(layout(make_plan(counts, capacity)))  # bounded by capacity alone
    ranked = dense_rank(cut, ["doc_id", "piece", "start", "ids_crc32", "row"], ["length"], "rank")  # equal rows are dealt to buckets too

    def task(batches):
        rows = places.value
        keys = (rows[:, 0] << 40) + rows[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 40) + rank, "right") - 1
            _, first, each, sequence, offset = rows[at].T
            cols = {f.name: strings(batch.column(f.name)) for f in PIECES}
            cols["sequence_id"] = (sequence + (rank - first) // each).tolist()
            cols["offset"] = (offset + (rank - first) % each * length).tolist()
            yield out_batch(PLACE, cols)

    return ranked.mapInArrow(task, PLACE)
