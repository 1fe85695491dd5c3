"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf. The leaves of a ``source`` ascend by doc_id; ``FAN`` consecutive nodes become the hash of
their digests until one is left, the subroot. The subroots, ordered by source, are folded alike into the root.

Time-forward processing: a node waits in a queue ordered by node label until the digests of all its children
have come as messages, and sends its own digest on to its parent. Then a reversed sweep starts at the
root: a node that gets the proof suffix that holds from itself to the root sends every child that suffix with the child's
siblings put before it. Leaves end up with their proofs.

The queue is external: between tasks it is Spark's shuffle, sorted by label (source, block, place; it spills), and
inside a block of ``FAN`` ** ``LEVELS`` nodes a heap. A phase moves all messages up (or down) ``LEVELS`` levels
and is a written table, so a lost executor repeats one phase at most, and there are as many phases as digits of the
largest source to the base of a block: four for 10 ** 14 rows. Texts never leave the scan: a shuffled row holds a
doc_id and digests, and a proof, of some kilobytes, is only ever sent to the top of a block.

A source that holds a third of all rows is many blocks: rows are numbered inside their source by a range
partitioning of all rows and running sums of its counts, never in one task.

Defined results: a null field is ``-``; a null source comes first, a null doc_id first in its source; rows that
agree in doc_id are ordered by their leaf, equal rows are leaves of their own each; very long texts are hashed by Spark
where they are read; an only row is its own subroot and, as an only source, the root, with an empty proof;
an empty table gives an empty result; only the columns of the manifest are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pairjudge.llm.common import out_batch, struct, written

FAN = 16
#: Levels that one task takes a block of nodes through; the heap holds ``FAN`` ** ``LEVELS`` messages at most.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64


def leaf(columns: Iterable[Column]) -> Column:
    """Digest of a row: every field as its UTF-8 byte count, a colon and the value, ``-`` for null."""
    def field(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def digest(nodes: Iterable[str]) -> str:
    return hashlib.sha256("".join(nodes).encode("ascii")).hexdigest()


def depth(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def forward(nodes: list[str], levels: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """Top digest of a block, and the digests that each inner node (level, place) got from its children."""
    got: dict[tuple[int, int], list[str]] = {}
    if not levels:
        return nodes[0], got
    queue = [(1, at // FAN, at % FAN, d) for at, d in enumerate(nodes)]
    while True:
        level, place = label = queue[0][:2]
        got[label] = children = []
        while queue and queue[0][:2] == label:
            children.append(heappop(queue)[3])
        if level == levels:
            return digest(children), got
        heappush(queue, (level + 1, place // FAN, place % FAN, digest(children)))


def backward(got: dict[tuple[int, int], list[str]], levels: int, suffix: str) -> Iterator[tuple[int, str]]:
    """(place, proof) of every node of the block, last place first, from the proof of the block's top."""
    queue = [(-levels, 0, suffix)]
    while queue:
        level, place, suffix = heappop(queue)
        if not level:
            yield -place, suffix
            continue
        children = got[-level, -place]
        for at in range(len(children)):
            heappush(queue, (level + 1, place * FAN - at, "".join(children[:at] + children[at + 1:]) + suffix))


def fold(node: str, at: int, n: int, proof: str, used: int = 0) -> tuple[str, int]:
    """Root over ``n`` nodes from the one at place ``at`` and its siblings in ``proof`` from ``used`` on."""
    while n > 1:
        own, size = at % FAN, min(FAN, n - at // FAN * FAN) - 1
        siblings = proof[used:used + HEX * size]
        node = digest((siblings[:HEX * own], node, siblings[HEX * own:]))
        at, n, used = at // FAN, -(-n // FAN), used + HEX * size
    return node, used


NODES = "part string, block long, i long, n long, digest string, doc_id long, claimed string, name string"
MESSAGES = "part string, i long, proof string, subroot string, root string, source_i long, source_n long"
TOPS = struct("part string, i long, n long, digest string")
OUT = struct("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
_NODES, _MESSAGES = struct(NODES), struct(MESSAGES)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (a written table) with ``i``, the place in its ``part`` by ``order``, and ``n``, the rows of the part."""
    keys = ["part", *order, "row"]
    ranged = written(rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
                     .withColumn("place", F.monotonically_increasing_id()).withColumn("task", F.shiftright("place", 33)).drop("row"), "merkle-order")
    # A row per part and task that has some of it.
    spans = ranged.groupBy("part", "task").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("held"))
    whole = Window.partitionBy("part")
    before = whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("part", "task", "first", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"), F.sum("held").over(whole).alias("n"))
    return (ranged.join(spans, ["part", "task"]).withColumn("i", F.col("before") + F.col("place") - F.col("first"))
            .drop("before", "place", "first", "task"))


def by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("part", "block").sortWithinPartitions("part", "block", "i")


def blocks(batches) -> Iterator[list[dict]]:
    """The rows of each block; a block is together and sorted, but may cross batches."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["part"], row["block"]) != (held[0]["part"], held[0]["block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _emit(rows: Iterator[tuple], schema: T.StructType, size: int = 4096):
    names, held = schema.names, []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield out_batch(schema, dict(zip(names, map(list, zip(*held)))))
            held = []
    if held:
        yield out_batch(schema, dict(zip(names, map(list, zip(*held)))))


def sweep_up(nodes: DataFrame, most: int) -> DataFrame:
    """The top of every block as a node of the next phase."""

    def task(batches):
        def tops():
            for rows in blocks(batches):
                n = rows[0]["n"]
                levels = min(most, depth(n))
                yield rows[0]["part"], rows[0]["block"], -(-n // FAN ** levels), forward([r["digest"] for r in rows], levels)[0]
        yield from _emit(tops(), TOPS)

    return by_block(nodes).mapInArrow(task, TOPS)


def climb(nodes: DataFrame, most: int, tag: str) -> list[DataFrame]:
    """Tables of nodes by phase of ``most`` levels; the last one has a node, its top, for each part."""
    block = F.expr(f"i div {FAN ** most}")
    tables = [written(_as(nodes.withColumn("block", block), _NODES), f"{tag}-nodes")]
    while (tables[-1].agg(F.max("n")).first()[0] or 0) > 1:
        tables.append(written(_as(sweep_up(tables[-1], most).withColumn("block", block), _NODES), f"{tag}-nodes"))
    return tables


def _as(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def sweep_down(nodes: DataFrame, messages: DataFrame, most: int, kind: str) -> DataFrame:
    """Deliver every block's message, ahead of its nodes, and pass it on to them: as messages to the blocks that they
    are the tops of (``inner``), to the sources (``source``), or as the rows of the result (``document``)."""
    sent = messages.select("part", F.col("i").alias("block"), F.lit(-1).cast("long").alias("i"), "proof", "subroot", "root", "source_i", "source_n")
    wide = T.StructType([*_NODES, *_MESSAGES[2:]])
    queue = by_block(_as(nodes, wide).unionByName(_as(sent, wide)))
    schema = OUT if kind == "document" else _MESSAGES

    def task(batches):
        def answers():
            for message, *rows in blocks(batches):
                levels = min(most, depth(rows[0]["n"]))
                got = forward([r["digest"] for r in rows], levels)[1]
                for at, proof in backward(got, levels, message["proof"]):
                    r = rows[at]
                    if kind == "inner":
                        yield r["part"], r["i"], proof, message["subroot"], message["root"], message["source_i"], message["source_n"]
                    elif kind == "source":
                        yield r["name"], 0, proof, r["digest"], message["root"], r["i"], r["n"]
                    else:
                        top, used = fold(r["claimed"], r["i"], r["n"], proof)
                        top, _ = fold(top, message["source_i"], message["source_n"], proof, used)
                        yield r["doc_id"], r["digest"], message["subroot"], message["root"], digest((proof,)), top, top == message["root"]
        yield from _emit(answers(), schema, 256 if kind == "inner" else 4096)

    return queue.mapInArrow(task, schema)


def manifest(documents: DataFrame, claimed: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root and proof_sha256 of every row; folded_root, recomputed from the row as ``claimed``
    (columns by name that stand for those of the manifest; the row itself without any) and its proof; verified."""
    now = {**{f: F.col(f) for f in FIELDS}, **(claimed or {})}
    leaves = written(documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0")).alias("part"),
        leaf(F.col(f) for f in FIELDS).alias("digest"), leaf(now[f] for f in FIELDS).alias("claimed")), "merkle-leaves")
    trees = climb(numbered(leaves, ["doc_id", "digest"]), levels, "merkle")
    subroots = trees[-1].select(F.lit("").alias("part"), F.col("part").alias("name"), "digest")
    forest = climb(numbered(subroots, ["name"]), levels, "merkle-forest")
    messages = _as(forest[-1].select("part", "i", F.lit("").alias("proof"), F.col("digest").alias("root")), _MESSAGES)
    steps = [(nodes, "inner") for nodes in forest[-2:0:-1]] + [(forest[0], "source")] + [(nodes, "inner") for nodes in trees[-2:0:-1]]
    for nodes, kind in steps:
        messages = written(sweep_down(nodes, messages, levels, kind), "merkle-messages")
    return sweep_down(trees[0], messages, levels, "document")
