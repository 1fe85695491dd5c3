"""Language-model scoring with Katz backoff.

Tokens are the words of a text (``[^\\x20\\x09-\\x0D]+``, A-Z in lower case), then one end; the history of the first
ones is filled with a start, which is no token. The model has the n-grams of 1 to ``ORDER`` tokens of the
training documents. A seen n-gram gets its Good-Turing discounted share d(c) * c / c(history), any other one the backoff
weight of its history times the probability of the n-gram without its first token:

* d(r) is Katz's discount from the numbers of n-grams with counts r and r + 1, up to the largest count, ``CUT`` at most,
  for which all are between 0 and 1; where there is no such count (tiny corpora), half a count is taken off each.
* The weight of a history is exactly the mass that its discounts leave, over the mass that the shorter history gives to
  tokens not seen after it; a history that leaves nothing counts one more token. Without history, the mass left is that
  of one unknown word. So the probabilities after any history sum to 1.

Tables: documents are gathered to blocks of about ``BLOCK_BYTES`` of text, written once as local token numbers. A block asks each
partition of the count table for its distinct n-grams, as one packed row of sorted hashes with the block's own training counts; so
a partition sees any n-gram once a block at most, however frequent it is, and adds up and answers in the same order.
Of equal n-grams the first block that trains on it owns it; owners' sums of counts, discounted counts and shorter
probabilities, added up per history in a second partitioned table, give the weights. The last pass evaluates the recursion for the
distinct n-grams of each block, then every token. Counts, their spectrum and the weights are written tables partitioned by a hash of
the n-gram in a scratch folder that is removed when the scores are written; nothing but ``CUT`` + 3 numbers an order comes to the driver, and nothing is broadcast.

N-grams are told apart by 64 bits of hash and the number of their partition, which grows with the corpus.

Defined results: a null text is an empty one, an end alone; a null doc_id counts as an empty string, is held out, and is scored like
any other; a text is taken whole, and one longer than a block is a block of its own; repeated rows are scored, and learnt from,
each; without training tokens every token has probability 1 (score 0); an empty table gives an empty result; only doc_id and text are read, so
other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairjudge.llm.common import Scratch, out_batch, pack, pack_keys, slices, struct, unpack, unpack_keys, written

ORDER = 2
CUT = 5
#: Bytes of text in a block, and tokens of the corpus for each partition of a table.
BLOCK_BYTES = 8 << 20
PART_TOKENS = 2_000_000
END = b"\n"  # no word holds white space
_START = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def mixed(history: np.ndarray, word: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hash of a history's and a word's hashes."""
    x = history * np.uint64(salt) + word
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


# Blocks

BLOCKS = struct("block long, n_tokens long, doc_ids binary, null_ids binary, held binary, lengths binary, tokens binary, words binary")


def blocks(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents gathered to blocks: local token numbers, those of the most frequent words in fewer bytes, and the words."""

    def task(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in slices(batches):
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= block_bytes:
                yield _gathered(number, held)
                number, held, size = number + 1, [], 0
        if held:
            yield _gathered(number, held)

    return (documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"),
                             F.col("text").cast("string").alias("text")).mapInArrow(task, BLOCKS))


def _gathered(number: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    texts = pc.fill_null(table["text"], "").combine_chunks()
    # The ASCII functions know A-Z and the white space of the token pattern, nothing else.
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten()
    some = pc.greater(pc.binary_length(words), 0)  # white space at an end gives an empty word
    ends = np.cumsum(some.to_numpy(zero_copy_only=False))[np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)) - 1]
    coded = words.filter(some).dictionary_encode()
    n_words, n_docs = len(coded), len(ends)
    at = np.ones(n_words + n_docs, dtype=bool)
    at[ends + np.arange(n_docs)] = False  # the ends
    ids = np.full(len(at), len(coded.dictionary), dtype=np.uint32)
    ids[at] = coded.indices.to_numpy(zero_copy_only=False)
    words = pa.concat_arrays([coded.dictionary, pa.array([END.decode()])])
    rank = np.empty(len(words), dtype=np.int64)
    rank[np.argsort(-np.bincount(ids, minlength=len(words)), kind="stable")] = np.arange(len(words))
    order = pc.sort_indices(words).to_numpy()  # the words of as many bytes by their letters, so that they pack well
    order = order[np.argsort(np.searchsorted([1 << 8, 1 << 16, 1 << 24], rank[order], "right"), kind="stable")]
    number_of = np.empty(len(words), dtype=np.uint32)
    number_of[order] = np.arange(len(words), dtype=np.uint32)
    listed = b" ".join(words.take(pa.array(order)).cast(pa.binary()).to_pylist())
    doc_ids = table["doc_id"]
    return out_batch(BLOCKS, {
        "block": [number], "n_tokens": [len(ids)],
        "doc_ids": [pack(pc.fill_null(doc_ids, 0).to_numpy())], "null_ids": [pack(pc.is_null(doc_ids).to_numpy())],
        "held": [pack(table["held"].to_numpy())], "lengths": [pack(np.diff(ends, prepend=0).astype(np.int64) + 1)],
        "tokens": [pack(number_of[ids])], "words": [zstandard.ZstdCompressor(level=3).compress(listed)]})


class Grams:
    """Distinct n-grams of one order in a block; the last of ``high`` and ``low`` is the start, which is only a history."""

    def __init__(self, at: np.ndarray, high: np.ndarray, low: np.ndarray, history: np.ndarray | None, shorter: np.ndarray | None):
        self.at, self.high, self.low, self.history, self.shorter = at, high, low, history, shorter
        self.n = len(high) - 1

    def dealt(self, parts: int, histories: bool) -> tuple[np.ndarray, np.ndarray]:
        """N-grams (with the start, for ``histories``) in the order they are asked for, and where each partition's begin."""
        n, bits = self.n + histories, np.uint64(int(parts).bit_length())
        key = (self.low[:n] % np.uint64(parts)) << (np.uint64(64) - bits) | self.high[:n] >> bits
        order = np.argsort(key)
        key = key[order]
        if (key[1:] == key[:-1]).any():  # the same order on every machine
            order = np.lexsort((self.high[:n], self.low[:n] % np.uint64(parts)))
        return order, np.searchsorted(key >> (np.uint64(64) - bits), np.arange(parts + 1, dtype=np.uint64))


class Block:
    def __init__(self, row: dict, order: int):
        self.row = row
        self.lengths, self.held = unpack(row["lengths"], np.int64), unpack(row["held"], np.bool_)
        tokens = unpack(row["tokens"], np.uint32).astype(np.int32)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(~self.held, self.lengths)
        prints = b"".join(map(xxhash.xxh3_128_digest, zstandard.ZstdDecompressor().decompress(row["words"]).split(b" ")))
        high, low = (np.append(h, s) for h, s in zip(np.frombuffer(prints, dtype=">u8").astype(np.uint64).reshape(-1, 2).T, _START))
        words = Grams(tokens, high, low, None, None)
        self.grams = [words]
        for _ in range(1, order):
            short = self.grams[-1]
            history = np.empty(len(tokens), dtype=np.int64)
            history[1:] = short.at[:-1]
            history[self.starts] = short.n
            history *= words.n + 1
            history += tokens
            codes, at = np.unique(history, return_inverse=True)
            del history
            at = at.astype(np.int32)
            shorter = np.empty(len(codes), dtype=np.int32)
            shorter[at] = short.at
            begun, last = np.divmod(codes, words.n + 1)
            hashes = [np.append(mixed(h[begun], w[last], salt), mixed(h[-1:], w[-1:], salt)) for h, w, salt in (
                (short.high, words.high, 0x9E3779B97F4A7C15), (short.low, words.low, 0xD1B54A32D192ED03))]
            self.grams.append(Grams(at, *hashes, begun.astype(np.int32), shorter))


# Partitioned tables: every block sends each partition one row of sorted keys and values, and gets as many answers back.

ASKED = struct("kind int, part int, block long, keys binary, a binary, b binary, c binary")
COUNTS = struct("kind int, part int, block long, a binary, b binary, spectrum array<long>")
WEIGHTS = struct("kind int, part int, block long, a binary, b binary")


def _rows(kind: int, block: int, grams: Grams, parts: int, values: list[np.ndarray], histories: bool) -> Iterator[dict]:
    order, begins = grams.dealt(parts, histories)
    for part in np.flatnonzero(np.diff(begins)).tolist():
        own = order[begins[part]:begins[part + 1]]
        packed = [pack(v[own]) for v in values] + [None] * (3 - len(values))
        yield {"kind": kind, "part": part, "block": block, "keys": pack_keys(grams.high[own]), **dict(zip("abc", packed))}


def _batches(rows: Iterator[dict], schema: StructType, size: int = 64):
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield out_batch(schema, {n: [r[n] for r in held] for n in schema.names})
            held = []
    if held:
        yield out_batch(schema, {n: [r[n] for r in held] for n in schema.names})


def _merged(table: pa.Table) -> tuple[list[dict], np.ndarray, np.ndarray, np.ndarray]:
    """Rows by block, where each one's keys begin, distinct keys, and the number of each key's."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    keys = [unpack_keys(r["keys"]) for r in rows]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return rows, np.cumsum([0, *map(len, keys)]), found, at


def _column(rows: list[dict], name: str, dtype) -> np.ndarray:
    return np.concatenate([unpack(r[name], dtype) for r in rows])


def _table(schema: StructType, rows: list[dict]) -> pa.Table:
    return pa.Table.from_batches([out_batch(schema, {n: [r.get(n) for r in rows] for n in schema.names})])


def counts(held: DataFrame, order: int, parts: int) -> DataFrame:
    """The count table: for every row asked, training counts (``a``) and whether the block owns the n-gram (``b``); for every partition
    a row of block -1 with its spectrum: n-grams seen 1, ..., CUT + 1 times, all seen ones, their tokens."""

    def ask(batches):
        def rows():
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block(row, order)
                    for kind, grams in enumerate(block.grams, 1):
                        own = np.bincount(grams.at[block.train], minlength=grams.n).astype(np.uint32)
                        yield from _rows(kind, row["block"], grams, parts, [own], False)
        yield from _batches(rows(), ASKED)

    def answer(key, table):
        rows, begins, found, at = _merged(table)
        own = _column(rows, "a", np.uint32)
        total = np.bincount(at, weights=own, minlength=len(found)).astype(np.int64)
        trained = np.flatnonzero(own)
        owner = np.zeros(len(at), dtype=bool)
        owner[trained[np.unique(at[trained], return_index=True)[1]]] = True
        spectrum = np.bincount(np.minimum(total, CUT + 2), minlength=CUT + 3)
        kind, part = key[0].as_py(), key[1].as_py()
        out = [{"kind": kind, "part": part, "block": r["block"], "a": pack(total[at[a:b]].astype(np.uint64)), "b": pack(owner[a:b])}
               for r, a, b in zip(rows, begins, begins[1:])]
        out.append({"kind": kind, "part": part, "block": -1, "spectrum": [*spectrum[1:CUT + 2].tolist(), int(spectrum[1:].sum()), int(total.sum())]})
        return _table(COUNTS, out)

    return held.mapInArrow(ask, ASKED).groupBy("kind", "part").applyInArrow(answer, COUNTS)


def discounts(spectrum: list[int]) -> np.ndarray:
    """Factor of the counts 0, 1, ..., CUT; larger ones are kept whole."""
    n = [0, *spectrum]
    for cut in range(CUT, 1, -1):
        if not all(n[1:cut + 2]) or (cut + 1) * n[cut + 1] >= n[1]:
            continue
        taken = (cut + 1) * n[cut + 1] / n[1]
        d = [((r + 1) * n[r + 1] / (r * n[r]) - taken) / (1 - taken) for r in range(1, cut + 1)]
        if all(0 < x < 1 for x in d):
            return np.array([0.0, *d, *[1.0] * (CUT - cut)])
    return np.array([0.0, *((r - 0.5) / r for r in range(1, CUT + 1))])


class Model:
    """What every block needs to know of the whole corpus: a few numbers an order."""

    def __init__(self, order: int, parts: int, spectra: dict[int, list[int]]):
        self.order, self.parts = order, parts
        empty = [0] * (CUT + 3)
        self.discounts = [discounts(spectra.get(k, empty)[:CUT + 1]) for k in range(1, order + 1)]
        self.types, self.tokens = spectra.get(1, empty)[-2:]
        seen = spectra.get(1, empty)[:CUT + 1]
        left = sum((1 - self.discounts[0][r]) * r * seen[r - 1] for r in range(1, CUT + 1))
        self.whole, self.unknown = (self.tokens, left / self.tokens) if left > 0 else (self.tokens + 1, 1 / (self.tokens + 1))

    def discounted(self, kind: int, total: np.ndarray) -> np.ndarray:
        return total * np.where(total > CUT, 1.0, self.discounts[kind - 1][np.minimum(total, CUT)])


class Answers:
    """Answers to a block, put back to the order of its n-grams."""

    def __init__(self, model: Model, block: Block, rows: list[dict]):
        self.model, self.block = model, block
        by = {(r["step"], r["kind"], r["part"]): r for r in rows}
        self.total, self.owned, self.weights = [], [], {}
        for kind, grams in enumerate(block.grams, 1):
            total, owned = self._back(by, "counts", kind, grams, False, (np.uint64, np.bool_))
            self.total.append(total.astype(np.int64))
            self.owned.append(owned)
            if ("weights", kind + 1, 0) in by or any(k[:2] == ("weights", kind + 1) for k in by):
                self.weights[kind + 1] = self._back(by, "weights", kind + 1, grams, True, (np.float64, np.float64))

    def _back(self, by: dict, step: str, kind: int, grams: Grams, histories: bool, dtypes) -> list[np.ndarray]:
        order, begins = grams.dealt(self.model.parts, histories)
        out = [np.zeros(len(order), dtype=d) for d in dtypes]
        for part in np.flatnonzero(np.diff(begins)).tolist():
            row = by[step, kind, part]
            for values, name, dtype in zip(out, "ab", dtypes):
                values[order[begins[part]:begins[part + 1]]] = unpack(row[name], dtype)
        return out

    def seen(self, kind: int) -> np.ndarray:
        """Probability of the n-grams of an order that have been seen; 0 for others."""
        mass = self.model.discounted(kind, self.total[kind - 1])
        if kind == 1:
            return mass / self.model.whole
        whole = self.weights[kind][0][self.block.grams[kind - 1].history]
        return np.divide(mass, whole, out=np.zeros(len(mass)), where=self.total[kind - 1] > 0)

    def log_probability(self, kind: int) -> np.ndarray:
        """log10 probability of every n-gram of an order."""
        p, grams = self.seen(kind), self.block.grams[kind - 1]
        with np.errstate(divide="ignore"):
            out = np.log10(p)
        if kind == 1:
            return np.where(self.total[0] > 0, out, np.log10(self.model.unknown))
        backed = self.weights[kind][1][grams.history] + self.log_probability(kind - 1)[grams.shorter]
        return np.where(self.total[kind - 1] > 0, out, backed)


def _answered(held: DataFrame, answers: DataFrame, model: Model, emit, schema: StructType) -> DataFrame:
    """Bring every block together with its answers; ``emit`` gives rows of ``schema`` from both."""

    def task(key, block, answers):
        if not block.num_rows:
            return _table(schema, [])
        whole = Block(block.to_pylist()[0], model.order)
        return _table(schema, list(emit(whole, Answers(model, whole, answers.to_pylist()))))

    return held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(task, schema)


def weights(held: DataFrame, answers: DataFrame, model: Model, kind: int) -> DataFrame:
    """The weight table of the histories of an order: what their seen n-grams are divided by (``a``), log10 of the weight (``b``)."""

    def ask(block: Block, found: Answers):
        grams, short = block.grams[kind - 1], block.grams[kind - 2]
        own = np.flatnonzero(found.owned[kind - 1])
        begun = grams.history[own]
        total = found.total[kind - 1][own]
        shorter = found.seen(kind - 1)[grams.shorter[own]]
        sums = [np.bincount(begun, weights=v, minlength=short.n + 1) for v in (total, model.discounted(kind, total), shorter)]
        sums[0] = sums[0].astype(np.uint64)
        yield from _rows(kind, block.row["block"], short, model.parts, sums, True)

    def answer(key, table):
        rows, begins, found, at = _merged(table)
        total, kept, shorter = (np.bincount(at, weights=_column(rows, c, d), minlength=len(found)) for c, d in zip("abc", (np.uint64, np.float64, np.float64)))
        left = total - kept
        whole = np.where(left > 0, total, total + 1)
        left = np.where(left > 0, left, 1.0) / whole
        weight = np.where(total > 0, np.log10(left) - np.log10(np.maximum(1 - shorter, 1e-300)), 0.0)
        return _table(WEIGHTS, [{"kind": key[0].as_py(), "part": key[1].as_py(), "block": r["block"], "a": pack(whole[at[a:b]]), "b": pack(weight[at[a:b]])}
                                for r, a, b in zip(rows, begins, begins[1:])])

    return _answered(held, answers, model, ask, ASKED).groupBy("kind", "part").applyInArrow(answer, WEIGHTS)


SCORES = struct("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(documents: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    with Scratch(documents.sparkSession, "katz") as scratch:
        return written(_scored(documents, order, block_bytes, scratch), "katz-scores")


def _scored(documents: DataFrame, order: int, block_bytes: int, scratch: Scratch) -> DataFrame:
    held = scratch.written(blocks(documents, block_bytes), "blocks")
    n_tokens = held.agg(F.sum("n_tokens")).first()[0] or 0
    parts = 1 + n_tokens // PART_TOKENS
    table = scratch.written(counts(held, order, parts), "counts")
    spectra = (table.where("block = -1").select("kind", F.posexplode("spectrum")).groupBy("kind", "pos").agg(F.sum("col").alias("n"))
               .groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("s")).collect())  # a row per order
    model = Model(order, parts, {r["kind"]: [x["n"] for x in r["s"]] for r in spectra})
    columns = ["block", "kind", "part", "a", "b"]
    answers = table.where("block >= 0").select(F.lit("counts").alias("step"), *columns)
    for kind in range(2, order + 1):
        found = scratch.written(weights(held, answers, model, kind), f"weights-{kind}")
        answers = answers.unionByName(found.select(F.lit("weights").alias("step"), *columns))

    def emit(block: Block, found: Answers):
        total, words = found.total[0], block.grams[0].at
        base = np.log10((total + 0.1) / (model.tokens + 0.1 * (model.types + 1)))[words]
        score = found.log_probability(order)[block.grams[-1].at]
        sums = [np.add.reduceat(v, block.starts).tolist() for v in ((total > 0)[words].astype(np.int64), base, score)]
        ids, nulls = unpack(block.row["doc_ids"], np.int64).tolist(), unpack(block.row["null_ids"], np.bool_).tolist()
        for doc, null, out, n, known, b, s in zip(ids, nulls, block.held.tolist(), block.lengths.tolist(), *sums):
            yield {"doc_id": None if null else doc, "held_out": out, "n_tokens": n, "n_known": known, "train_tokens": model.tokens, "base_score": b, "score": s}

    return _answered(held, answers, model, emit, SCORES)
