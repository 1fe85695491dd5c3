"""Substring deduplication by sliding sentence spans.

A text is cut into sentences (after . ! ? and white space, and at line feeds). Of any ``GAP`` words in a
row inside a sentence, the one with the smallest CRC-32 is cut after as well; that depends on these words
alone, so that the same words are cut alike wherever they stand, and no unit has more than ``GAP`` words.
From every unit on, the run of the fewest units, ``SENTENCES`` at least, that has ``WORDS`` words is hashed
(96 of 128 bits, and the number of a partition, over lower-cased, space-joined words). Runs are joined globally: of equal runs
the first by (doc_id, place) stays, and the units that any other one covers are removed: whole sentences, and of a sentence that
is only repeated in part the repeated part.

Any stretch of 51 words that stands in two places, with the same line feeds, holds a complete run: one of
its first GAP words ends a unit in both places, the run from there ends at the first cut after WORDS words,
GAP - 1 words later at most, and text around the stretch adds cuts inside its first and last GAP - 1 words
only. Words at both ends of a passage that are part of a unit, or too few for a run, may stay; nothing shorter than
WORDS words is removed.

Plan: texts are cut where they are read, in blocks of about ``BLOCK_BYTES``. A block sends every distinct run once, with its first
place in the block, as packed columns in one row for each partition of hashes, so a passage that a third of all documents
share is one entry a block there; its other places in the block are known not to be the first. Partitions answer with places
to remove, which are gathered by document and joined to the texts. Only texts with such places are cut a second time.

Defined results: null texts stay null, empty ones empty; a text with too few words for a run stays as
it is; rows that agree in doc_id and text are one document and keep the same sentences; rows with a
null doc_id come first in the order; a text is taken whole, and one longer than a block is a block of its own; an empty table gives an
empty result; only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pairjudge.llm.common import out_batch, pack, pack_keys, slices, strings, struct, unpack, unpack_keys, written

SENTENCES = 2
WORDS = 30
#: Words among which one cut is certain. A run from a cut in the first GAP words of a shared stretch ends at a cut
#: among the GAP words after its WORDS, before those that text behind the stretch may cut: 3 * GAP <= 54 - WORDS.
GAP = 8
#: Bytes of text that are cut in a block, and of all texts for each partition of hashes.
BLOCK_BYTES = 16 << 20
PART_BYTES = 16 << 20

_END = re.compile(r"""(?<![.!?])[.!?]++["')\]]*+\s+|[。！？]+\s*|\n\s*""")
_WORD = re.compile(r"\S+\s*")


def cuts(words: list[str]) -> list[int]:
    """Words that hold the smallest CRC-32 (the last of equal ones) of any ``GAP`` words in a row."""
    if len(words) <= GAP:
        return []
    prints = [zlib.crc32(w) for w in " ".join(words).encode("utf-8", "surrogatepass").split(b" ")]
    out = [at := _smallest(prints, 0, GAP)]
    for i in range(GAP, len(prints)):
        if prints[i] <= prints[at]:
            out.append(at := i)
        elif at == i - GAP:
            out.append(at := _smallest(prints, i - GAP + 1, i + 1))
    return out


def _smallest(prints: list[int], start: int, stop: int) -> int:
    part = prints[start:stop]
    return stop - 1 - part[::-1].index(min(part))


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-cased words) of each unit; together they cover the text."""
    out: list[tuple[int, int, list[str]]] = []
    start = 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        if end == start:
            continue
        words = text[start:end].lower().split()
        if not words and not out:  # white space before the first sentence is part of it
            continue
        if not words:  # and elsewhere of the sentence before
            out[-1] = (out[-1][0], end, out[-1][2])
        else:
            inner = cuts(words)
            if inner:
                stops = [m.end() for m in _WORD.finditer(text, start, end)]
                at = first = 0
                for cut in inner:
                    if cut < len(words) - 1:
                        out.append((start if not first else at, stops[cut], words[first:cut + 1]))
                        at, first = stops[cut], cut + 1
                out.append((start if not first else at, end, words[first:]))
            else:
                out.append((start, end, words))
        start = end
    return out or ([(0, len(text), [])] if text else [])


def runs(found: list[tuple[int, int, list[str]]]) -> Iterator[tuple[int, int, bytes]]:
    """(first unit, units, 128-bit hash) of the run from every unit on."""
    joined = [" ".join(words).encode("utf-8", "surrogatepass") for _, _, words in found]
    sizes = [len(words) for _, _, words in found]
    stop, words = 0, 0
    for first in range(len(found)):
        while stop < len(found) and (words < WORDS or stop - first < SENTENCES):
            words += sizes[stop]
            stop += 1
        if words < WORDS or stop - first < SENTENCES:
            return
        yield first, stop - first, xxhash.xxh3_128_digest(b" ".join(joined[first:stop]))
        words -= sizes[first]


ASKED = struct("part long, keys binary, low binary, ids binary, none binary, version binary, first binary, stop binary")
FOUND = struct("doc_id long, version int, n_sentences int, first int, stop int")
_PLACES = {"ids": np.int64, "none": np.bool_, "version": np.int32, "first": np.int32, "stop": np.int32}


def _block(texts: list[tuple[int | None, int, str | None]], parts: int) -> Iterator[dict]:
    """What a block sends: to each partition its runs, and to one the documents' units (no keys, ``stop`` 0) with the
    places that the block knows not to be the first (no keys)."""
    digests, places, units = [], [], []
    for doc, version, text in texts:
        cut = sentences(text or "")
        document = (doc or 0, doc is None, version)
        units.append((*document, len(cut), 0))
        for first, many, digest in runs(cut):
            digests.append(digest)
            places.append((*document, first, first + many))
    prints = np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    at = dict(zip(_PLACES, (np.array(c, dtype=d) for c, d in zip(zip(*places), _PLACES.values())))) if places else {n: np.zeros(0, d) for n, d in _PLACES.items()}
    keys, low = prints[:, 0], prints[:, 1].astype(np.uint32)
    part = (prints[:, 1] >> np.uint64(32)) % np.uint64(parts)
    order = np.lexsort((at["first"], at["version"], at["ids"], ~at["none"], low, keys, part))
    keys, low, part, at = keys[order], low[order], part[order], {n: v[order] for n, v in at.items()}
    begins = _begins(part, keys, low)
    later = np.flatnonzero(~begins & ~_same_place(begins, at))
    own = {n: np.concatenate([np.array(u, dtype=v.dtype), v[later]]) for (n, v), u in zip(at.items(), zip(*units))}
    yield {"part": zlib.crc32(prints.tobytes()) % parts, **{n: pack(v) for n, v in own.items()}}
    sent = np.flatnonzero(begins)
    bounds = np.searchsorted(part[sent], np.arange(parts + 1, dtype=np.uint64))
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        rows = sent[bounds[p]:bounds[p + 1]]
        yield {"part": p, "keys": pack_keys(keys[rows]), "low": pack(low[rows]), **{n: pack(v[rows]) for n, v in at.items()}}


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where a new run begins in sorted columns."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _same_place(begins: np.ndarray, at: dict[str, np.ndarray]) -> np.ndarray:
    """Whether a place is that of the first of its run: a repeated row."""
    leader = np.flatnonzero(begins)[np.cumsum(begins) - 1]
    return np.all([at[n][leader] == at[n] for n in ("ids", "none", "version", "first")], axis=0)


def _found(at: dict[str, np.ndarray], rows: np.ndarray) -> pa.Table:
    v = {n: c[rows] for n, c in at.items()}
    units = v["stop"] == 0
    return pa.table([pa.array(v["ids"], mask=v["none"]), pa.array(v["version"]), pa.array(v["first"], mask=~units),
                     pa.array(v["first"], mask=units), pa.array(v["stop"], mask=units)], schema=to_arrow_schema(FOUND))


def repeats(documents: DataFrame) -> DataFrame:
    """n_sentences and the ranges [first, stop) of units to remove, of every doc_id and version."""
    parts = 1 + (documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES

    def ask(batches):
        held, size = [], 0
        for batch in slices(batches):
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= BLOCK_BYTES:
                yield from blocks(held)
                held, size = [], 0
        yield from blocks(held)

    def blocks(held):
        texts = [row for batch in held for row in zip(*(strings(batch.column(c)) for c in ("doc_id", "version", "text")))]
        held.clear()
        if texts:
            for row in _block(texts, parts):
                yield out_batch(ASKED, {n: [row.get(n)] for n in ASKED.names})

    def answer(key, table):
        runs_ = table.filter(pc.is_valid(table["keys"])).to_pylist()
        own = table.filter(pc.is_null(table["keys"])).to_pylist()
        out = []
        if own:
            at = {n: np.concatenate([unpack(r[n], d) for r in own]) for n, d in _PLACES.items()}
            out.append(_found(at, np.arange(len(at["ids"]))))
        if runs_:
            keys = np.concatenate([unpack_keys(r["keys"]) for r in runs_])
            often = _repeated(keys)
            keys, low = keys[often], np.concatenate([unpack(r["low"], np.uint32) for r in runs_])[often]
            at = {n: np.concatenate([unpack(r[n], d) for r in runs_])[often] for n, d in _PLACES.items()}
            order = np.lexsort((at["first"], at["version"], at["ids"], ~at["none"], low, keys))
            at = {n: v[order] for n, v in at.items()}
            begins = _begins(keys[order], low[order])
            out.append(_found(at, np.flatnonzero(~begins & ~_same_place(begins, at))))
        return pa.concat_tables(out)

    found = documents.mapInArrow(ask, ASKED).groupBy("part").applyInArrow(answer, FOUND)
    return found.groupBy("doc_id", "version").agg(F.max("n_sentences").alias("n_sentences"), F.collect_set(
        F.when(F.col("first").isNotNull(), F.struct("first", "stop"))).alias("ranges"))


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether another entry has the same key."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


CLEAN = struct("doc_id long, text string, n_sentences long, n_removed long, removed_chars long")


def without(text: str, ranges: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the units in ``ranges``; units removed."""
    found = sentences(text)
    gone = bytearray(len(found))
    for first, stop in ranges:
        gone[first:stop] = b"\x01" * (stop - first)
    return "".join(text[a:b] for (a, b, _), g in zip(found, gone) if not g), sum(gone)


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, text without repeated spans, n_sentences, n_removed, removed_chars of every row."""
    version = F.shiftright(F.xxhash64("text"), 32).cast("int")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("version", version)
    found = written(repeats(docs), "repeats").select(F.col("doc_id").alias("other_id"), F.col("version").alias("other_version"), "n_sentences", "ranges")
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("version") == F.col("other_version")), "left").select(
        "doc_id", "text", "n_sentences", "ranges")

    def task(batches):
        for batch in slices(batches):
            cols: dict[str, list] = {f.name: [] for f in CLEAN}
            for doc, text, n, ranges in zip(*(strings(batch.column(c)) for c in ("doc_id", "text", "n_sentences", "ranges"))):
                clean, removed = without(text, [(r["first"], r["stop"]) for r in ranges]) if ranges else (text, 0)
                cols["doc_id"].append(doc)
                cols["text"].append(clean)
                cols["n_sentences"].append(n)
                cols["n_removed"].append(removed)
                cols["removed_chars"].append(len(text or "") - len(clean or ""))
            yield out_batch(CLEAN, cols)

    return joined.mapInArrow(task, CLEAN)
