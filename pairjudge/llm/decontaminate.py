"""Benchmark decontamination by winnowing.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Of every window of
``WINDOW`` words, the smallest hash of its ``KGRAM``-word grams is its fingerprint, so neighbouring
windows mostly share one fingerprint and two equal windows always have the same one: every shared
span of ``WINDOW`` words is found. A document's fingerprints are joined with those of the benchmark;
only windows whose fingerprint meets one are extended, that is compared word for word.

Items shorter than ``WINDOW`` words are one window of their own length; those few lengths are
looked up by the hash of the whole window.

Plan: the benchmark's windows are deduplicated by Spark and brought in blocks of at most
``BLOCK_WINDOWS`` (window, item) pairs to the tasks that scan the documents. One block, the usual
case, is one pass without any shuffle of documents. More blocks are more passes, whose hits are
merged per document.

Defined results: null or wordless texts have no words and are clean; an empty benchmark leaves every
document clean; repeated rows get a row each; an item whose ``item_id`` is null marks words but is
not counted as an item.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairjudge.llm.common import PIECE_BYTES, out_batch, packed, slices, strings, text_digest, unpacked, written

WINDOW = 10
KGRAM = 5
#: (window, item) pairs that a task holds at a time; bounds the broadcast to some 50 MB.
BLOCK_WINDOWS = 200_000

_SPLIT = bytes((b + 32 if 0x41 <= b <= 0x5A else 32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b) for b in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Word positions and hashes of one buffer of normalised bytes."""

    _pow = _powers(_BASE, 1 << 16)
    _inv = _powers(_INVERSE, 1 << 16)

    def __init__(self, buf: bytes):
        if len(buf) + 1 > len(Words._pow):
            n = 1 << (len(buf) + 1).bit_length()
            Words._pow, Words._inv = _powers(_BASE, n), _powers(_INVERSE, n)
        raw = np.frombuffer(buf, dtype=np.uint8)
        edge = np.diff((raw != 32).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.buf, self.starts, self.ends = buf, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * Words._pow[: len(raw)], out=total[1:])
        self.hash = _mix((total[self.ends] - total[self.starts]) * Words._inv[self.starts])

    def __len__(self) -> int:
        return len(self.starts)

    def grams(self, n: int) -> np.ndarray:
        """Hash of every run of ``n`` words."""
        count = max(0, len(self) - n + 1)
        out = np.zeros(count, dtype=np.uint64)
        for j in range(n):
            out = out * np.uint64(_BASE) + self.hash[j:j + count]
        return _mix(out)

    def fingerprints(self, window: int = WINDOW, k: int = KGRAM) -> np.ndarray:
        """The smallest k-gram hash of every window of ``window`` words."""
        grams = self.grams(k)
        count = max(0, len(self) - window + 1)
        out = grams[:count].copy()
        for j in range(1, window - k + 1):
            np.minimum(out, grams[j:j + count], out=out)
        return out

    def span(self, i: int, n: int) -> bytes:
        return b" ".join(self.buf[s:e] for s, e in zip(self.starts[i:i + n].tolist(), self.ends[i:i + n].tolist()))


def normalise(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_SPLIT)


class Fingerprints:
    """Membership of 64-bit hashes: a bit table first, then a sorted array."""

    def __init__(self, hashes: np.ndarray):
        self.keys = np.unique(hashes)
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[(self.keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = self.bits[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
            out[at] = self.keys[place] == hashes[at]
        return out


class Index:
    """Benchmark windows of one block, by length, with the items that hold them."""

    def __init__(self, pairs: list[tuple[bytes, int, str | None]]):
        self.items: dict[bytes, list[str | None]] = {}
        lengths: dict[int, set[bytes]] = {}
        for window, n, item in pairs:
            self.items.setdefault(window, []).append(item)
            lengths.setdefault(n, set()).add(window)
        self.short = {n: Fingerprints(np.concatenate([Words(w).grams(n) for w in ws])) for n, ws in lengths.items() if n < WINDOW}
        full = lengths.get(WINDOW)
        self.full = Fingerprints(np.concatenate([Words(w).fingerprints() for w in full])) if full else None

    def hits(self, words: Words) -> Iterator[tuple[int, int, list[str | None]]]:
        """(first word, words, items) of every place where a benchmark window occurs."""
        for n, grams in self.short.items():
            for i in np.flatnonzero(grams.has(words.grams(n))).tolist():
                if found := self.items.get(words.span(i, n)):
                    yield i, n, found
        if self.full is not None and len(words) >= WINDOW:
            smallest = words.fingerprints()
            new = np.append(True, smallest[1:] != smallest[:-1])  # winnowing: a fingerprint is kept once
            met = self.full.has(smallest[new])
            for i in np.flatnonzero(met[np.cumsum(new) - 1]).tolist():
                if found := self.items.get(words.span(i, WINDOW)):
                    yield i, WINDOW, found


def pieces(buf: bytes, limit: int = PIECE_BYTES, overlap: int = WINDOW - 1) -> Iterator[tuple[int, Words]]:
    """(number of the first word, words) of pieces that overlap by ``overlap`` words."""
    at, first = 0, 0
    while True:
        size = limit
        while True:
            end = len(buf) if at + size >= len(buf) else buf.rfind(b" ", at, at + size)
            words = Words(buf[at:end]) if end > at else None
            if end == len(buf) or (words is not None and len(words) > overlap):
                break
            size *= 2  # fewer than ``overlap`` giant words
        yield first, words if words is not None else Words(b"")
        if end == len(buf):
            return
        first += len(words) - overlap
        at += int(words.starts[-overlap])


def document_hits(text: str | None, index: Index) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, [first, last + 1) word ranges that are hit (merged), items found."""
    ranges: list[tuple[int, int]] = []
    items: set[str] = set()
    n_words = 0
    for first, words in pieces(normalise(text or "")):
        n_words = first + len(words)
        for i, n, found in index.hits(words):
            ranges.append((first + i, first + i + n))
            items.update(x for x in found if x is not None)
    return n_words, merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


WINDOWS = T.StructType([T.StructField("window", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("item", T.StringType())])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct (window, length, item) of the benchmark's texts."""

    def cut(batches):
        for batch in slices(batches):
            cols: dict[str, list] = {"window": [], "n": [], "item": []}
            for item, text in zip(strings(batch.column("item")), strings(batch.column("text"))):
                buf = normalise(text or "")
                for first, words in pieces(buf):
                    n = WINDOW if first else min(WINDOW, len(words))  # only a whole item may be shorter than a window
                    for i in range(len(words) - n + 1 if n else 0):
                        cols["window"].append(words.span(i, n))
                        cols["n"].append(n)
                        cols["item"].append(item)
            yield out_batch(WINDOWS, cols)

    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(cut, WINDOWS).distinct()


FOUND = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.StringType()), T.StructField("n_words", T.LongType()),
    T.StructField("ranges", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
    T.StructField("ranges", T.ArrayType(T.LongType()))])


def _digest(found: DataFrame) -> DataFrame:
    """Counts of each document from its hit ranges (flattened pairs) and items."""

    def count(batches):
        for batch in batches:
            cols: dict[str, list] = {f.name: [] for f in RESULT}
            for row in batch.to_pylist():
                flat = row["ranges"]
                ranges = merged(list(zip(flat[::2], flat[1::2])))
                items = sorted(set(row["items"]))
                hit = sum(b - a for a, b in ranges)
                cols["doc_id"].append(row["doc_id"])
                cols["n_words"].append(row["n_words"])
                cols["n_hit"].append(hit)
                cols["n_items"].append(len(items))
                cols["items_sha256"].append(hashlib.sha256(",".join(items).encode()).hexdigest())
                cols["contaminated"].append(hit > 0)
                cols["ranges"].append([x for r in ranges for x in r])
            yield out_batch(RESULT, cols)

    return found.mapInArrow(count, RESULT)


def contamination(documents: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: its words, words inside benchmark windows (``ranges``: first and
    last + 1 word number of each hit stretch, flattened), items found, verdict."""
    return _digest(_found(documents, benchmark, block_windows))


def _found(documents: DataFrame, benchmark: DataFrame, block_windows: int, keyed: bool = False) -> DataFrame:
    """Hit ranges and items of every document; ``text_hash`` is there if ``keyed``, and copies may then be one row."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = written(benchmark_windows(benchmark.select("item_id", F.col("text").cast("string").alias("text"))), "benchmark-windows")
    blocks = max(1, -(-windows.count() // block_windows))
    numbered = windows.withColumn("block", F.pmod(F.xxhash64("window", "item"), F.lit(blocks)))

    def scan(pairs):
        def task(batches):
            index = Index(pairs.value)
            for batch in slices(batches):
                cols: dict[str, list] = {f.name: [] for f in FOUND}
                for doc, hashed, text in zip(strings(batch.column("doc_id")), strings(batch.column("text_hash")), strings(batch.column("text"))):
                    n_words, ranges, items = document_hits(text, index)
                    cols["doc_id"].append(doc)
                    cols["text_hash"].append(hashed)
                    cols["n_words"].append(n_words)
                    cols["ranges"].append([x for r in ranges for x in r])
                    cols["items"].append(sorted(items))
                yield out_batch(FOUND, cols)
        return task

    hashed = docs.withColumn("text_hash", text_digest(F.col("text")) if keyed or blocks > 1 else F.lit(""))
    found = None
    for block in range(blocks):
        rows = numbered.where(F.col("block") == block).select("window", "n", "item").collect()  # at most about block_windows
        pairs = spark.sparkContext.broadcast([(bytes(r[0]), r[1], r[2]) for r in rows])
        part = hashed.mapInArrow(scan(pairs), FOUND).withColumn("block", F.lit(block))
        found = part if found is None else found.unionByName(part)
    if blocks > 1:  # copies agree in what each block finds: one row of them a block, however many they are
        one = found.groupBy("doc_id", "text_hash", "block").agg(*[F.first(c).alias(c) for c in ("n_words", "ranges", "items")])
        found = (one.groupBy("doc_id", "text_hash")  # a row a block
                 .agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("ranges")).alias("ranges"),
                      F.flatten(F.collect_list("items")).alias("items")))
        if not keyed:
            each = hashed.select(F.col("doc_id").alias("each_id"), F.col("text_hash").alias("each_hash"))
            found = (each.join(found, F.col("each_id").eqNullSafe(F.col("doc_id")) & F.col("each_hash").eqNullSafe(F.col("text_hash")))
                     .drop("each_id", "each_hash"))
    return found


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents none of whose words lies in a benchmark window; all columns kept.

    Rows are told apart by doc_id and text: a clean row stays, whatever other rows have its id or none."""
    found = _found(documents, benchmark, BLOCK_WINDOWS, keyed=True)
    bad = found.where(F.size("ranges") > 0).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_digest")).distinct()
    this = F.col("id").eqNullSafe(F.col("bad_id")) & F.col("digest").eqNullSafe(F.col("bad_digest"))
    return unpacked(packed(documents).join(bad, this, "left_anti"), documents)
