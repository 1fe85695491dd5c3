"""Fill-in-middle transformation with content-defined chunk memoization.

A text of n lines (``[^\\n]*\\n|[^\\n]+``) is cut after two numbers of lines, drawn from the sha256 of seed and doc_id, into
prefix, middle and suffix, which are put in the order psm or spm behind the marks ``<P>``, ``<S>`` and ``<M>``.

Line numbers and code points come from chunks: a rolling hash over the last 32 bytes ends a chunk wherever its
top bits are zero, so that the same passage is cut alike in every text that holds it. Each task remembers the boundary summary of
a chunk (lines that end in it, its code points, code points behind the last line end) under the chunk's whole
content, so that a remembered summary is only ever used for equal bytes. Summaries are combined by running sums:
these give n, and the chunk that a cut falls into; only inside that chunk are lines counted again.

The memory holds ``REMEMBERED`` bytes of chunks and then starts afresh; that changes speed only. Rows are
transformed where they are read: no shuffle.

Defined results: a null text is an empty one; an empty text, or one that holds a mark, stays plain; a null doc_id
counts as an empty string in the draw; texts are taken whole, whatever their length; repeated rows are cut alike; an
empty table gives an empty result; only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairjudge.llm.common import out_batch, slices, struct

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 7
#: Percent of texts that are transformed, and of these in the order suffix, prefix, middle.
RATE, SPM = 100, 50
#: Bytes of a chunk: least, on average beyond the least, and most.
LEAST, MEAN, MOST = 256, 1024, 8192
REMEMBERED = 32 << 20

_GEAR = np.array([zlib.crc32(bytes([i, 255 - i])) for i in range(256)], dtype=np.uint32)
_SHIFT = np.uint32(32 - (MEAN.bit_length() - 1))


def chunk_ends(data: bytes) -> list[int]:
    """Places where a chunk may end: the hash of the 32 bytes before has MEAN.bit_length() - 1 zeros on top."""
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    for width in (1, 2, 4, 8, 16):  # sums over 1, 2, ..., 32 bytes, each byte shifted by its distance
        h[width:] += h[:-width].copy() << np.uint32(width)
    return (np.flatnonzero(h >> _SHIFT == 0) + 1).tolist()


def chunks(data: bytes, start: int, end: int, ends: list[int]):
    """(start, end) of the chunks of a text that lies in ``data``; they never part the bytes of a code point."""
    while start < end:
        at = bisect_left(ends, start + LEAST)
        stop = min(ends[at] if at < len(ends) else end, start + MOST, end)
        for _ in range(3):
            stop -= stop < end and data[stop] & 0xC0 == 0x80
        yield start, stop
        start = stop


class Summaries(dict):
    """Chunk -> (line ends, code points, code points behind the last line end)."""

    held = 0

    def __missing__(self, chunk: bytes) -> tuple[int, int, int]:
        if self.held > REMEMBERED:
            self.clear()
            self.held = 0
        summary = chunk.count(b"\n"), code_points(chunk), code_points(chunk[chunk.rfind(b"\n") + 1:])
        self[chunk] = summary
        self.held += len(chunk)
        return summary


def code_points(data: bytes) -> int:
    return len(data) - sum(map(data.count, _CONTINUATION)) if len(data) < 64 else int(np.count_nonzero(np.frombuffer(data, np.int8) >= -64))


_CONTINUATION = [bytes([b]) for b in range(0x80, 0xC0)]


class Lines:
    """Line and code-point positions of a text by the summaries of its chunks."""

    def __init__(self, data: bytes, start: int, end: int, ends: list[int], cache: Summaries):
        self.data, self.spans = data, list(chunks(data, start, end, ends))
        found = [cache[data[a:b]] for a, b in self.spans]
        self.ended = list(accumulate((s[0] for s in found), initial=0))
        self.chars = list(accumulate((s[1] for s in found), initial=0))
        opened = 0
        for lines, chars, behind in found:
            opened = behind if lines else opened + chars
        self.n = self.ended[-1] + (opened > 0)
        self.start, self.end = start, end

    def cut(self, lines: int) -> tuple[int, int]:
        """Byte and code-point position behind the first ``lines`` lines."""
        if not lines:
            return self.start, 0
        if lines > self.ended[-1]:
            return self.end, self.chars[-1]
        at = bisect_left(self.ended, lines) - 1  # the chunk in which that line ends
        first, last = self.spans[at]
        place = first - 1
        for _ in range(lines - self.ended[at]):
            place = self.data.index(b"\n", place + 1, last)
        return place + 1, self.chars[at] + code_points(self.data[first:place + 1])


def draws(doc_id: int | None, seed: int) -> list[int]:
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(found[i:i + 8], 16) for i in range(0, 32, 8)]


OUT = struct("doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")


def transform(documents: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars and output of every row."""

    def task(batches):
        cache = Summaries()
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            data = b"".join(texts)
            ends, start = chunk_ends(data) if data else [], 0
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                lines = Lines(data, start, start + len(text), ends[bisect_left(ends, start):bisect_right(ends, start + len(text))], cache)
                start += len(text)
                h1, h2, h3, h4 = draws(doc, seed)
                if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
                    rows.append((doc, lines.n, "plain", None, None, text))
                    continue
                few, many = sorted((h1 % (lines.n + 1), h2 % (lines.n + 1)))
                (a, before), (b, until) = lines.cut(few), lines.cut(many)
                prefix, middle, suffix = data[lines.start:a], data[a:b], data[b:lines.end]
                form = "spm" if h4 % 100 < spm else "psm"
                output = (b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)) if form == "spm"
                          else b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
                rows.append((doc, lines.n, form, before, until - before, output))
            yield out_batch(OUT, dict(zip(OUT.names, map(list, zip(*rows)))))

    return (documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
            .mapInArrow(task, OUT).withColumn("output", F.col("output").cast("string")))


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` made ``output`` of. A transformed text holds no mark, so each mark stands once."""
    parts = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))
