"""SimHash near-duplicates with pivot distance tables.

A fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of a text's 4-word shingles.
Fingerprints that differ in ``MAX_BITS`` bits or fewer are linked, and documents that links or equal
fingerprints reach form a component.

Search: equal fingerprints are collapsed first. A table of Hamming distances to ``PIVOTS`` reference
fingerprints goes with each fingerprint; by the triangle inequality, two fingerprints can only be
linked if no coordinate of their rows in that table differs by more than ``MAX_BITS``. Distances to
random references alone would have to be compared for all pairs, so the table is applied within
groups: of 7 blocks of bits, a linked pair agrees in 3 at least, and each fingerprint joins the 35
groups named by 3 of its blocks. A group is worked through in squares of at most ``SQUARE`` x
``SQUARE``; a larger one is dealt to several tasks by pairs of its parts. Each square emits a spanning
forest of its links, never all pairs: no component loses a link that holds it together, and the rows
stay proportional to the fingerprints.

Defined results: a text without words (or null) has fingerprint zero and is linked like any other;
rows that repeat a document are copies of it; an empty table gives an empty result; a null doc_id is
kept and never is a component's name unless all its ids are null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairjudge.llm.common import out_batch, packed, slices, strings, text_digest, unpacked, written
from pairjudge.llm.components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
PIVOTS = 24
#: Members of a group that are compared at a time; larger groups are split into parts of this size.
SQUARE = 2048
#: First bit and width of each block; 3 more blocks than bits may differ.
BLOCKS = ((0, 9), (9, 9), (18, 9), (27, 9), (36, 9), (45, 9), (54, 10))

_GROUPS = [sum(((1 << w) - 1) << s for s, w in chosen) for chosen in combinations(BLOCKS, len(BLOCKS) - MAX_BITS)]
#: Shingles that are hashed before their bits are counted.
_RUN = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the whole text: bit set if set in over half of the shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-1])[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _RUN):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i:i + _RUN], stops[i:i + _RUN])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


PRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


KEYED = T.StructType([*PRINTS.fields, T.StructField("digest", T.StringType())])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, keyed: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), ``digest`` of the text if ``keyed``, of every row."""
    schema = KEYED if keyed else PRINTS

    def task(batches):
        for batch in slices(batches):
            prints = np.array([fingerprint(t, shingle) for t in strings(batch.column("text"))], dtype=np.uint64)
            cols = {"doc_id": strings(batch.column("doc_id")), "fp": prints.view(np.int64).tolist()}
            yield out_batch(schema, {**cols, "digest": strings(batch.column("digest"))} if keyed else cols)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (rows.withColumn("digest", text_digest(F.col("text"))) if keyed else rows).mapInArrow(task, schema)


def references(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of 0, 1, 2, ..."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(n)], dtype=np.uint64)


def distances(prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Pivot table: Hamming distance of each fingerprint to each reference."""
    return np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int8)


def square_links(left: np.ndarray, right: np.ndarray, pivots: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Spanning forest of the links between two arrays of fingerprints (or inside one).

    Rows of the pivot table whose coordinates differ by more than ``max_bits`` are discarded; the
    survivors' distances are computed. A pair that earlier links already connect is not emitted.
    """
    same = left is right
    table_l, table_r = distances(left, pivots), distances(right, pivots)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    order = np.argsort(table_r[:, 0], kind="stable")  # the first coordinate cuts out a range
    right, table_r = right[order], table_r[order]
    lows = np.searchsorted(table_r[:, 0], table_l[:, 0].astype(np.int16) - max_bits, "left")
    highs = np.searchsorted(table_r[:, 0], table_l[:, 0].astype(np.int16) + max_bits, "right")
    for i, x in enumerate(left):
        near = lows[i] + np.flatnonzero(np.abs(table_r[lows[i]:highs[i]] - table_l[i]).max(axis=1) <= max_bits)
        found = right[near][np.bitwise_count(right[near] ^ x) <= max_bits]
        for y in (found[found > x] if same else found[found != x]).tolist():
            a, b = root(int(x)), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(x), y))
    return out


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all that are ``max_bits`` apart."""
    if max_bits != MAX_BITS:
        raise ValueError(f"the groups are laid out for {MAX_BITS} differing bits")
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in _GROUPS])
    named = (prints.select("fp", F.posexplode(masks).alias("which", "mask"))
             .select(F.xxhash64(F.col("fp").bitwiseAND(F.col("mask")), "which").alias("grp"), "fp"))
    large = _large_groups(named, prints.count() * len(_GROUPS))
    if large is None:
        dealt = named.select("grp", *[F.lit(0).alias(c) for c in ("i", "j", "part")], "fp")
    else:  # members of part i meet those of every part j >= i
        parts = F.coalesce("parts", F.lit(1))
        dealt = (named.join(large, "grp", "left").withColumn("parts", parts)
                 .withColumn("part", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int"))
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                 .select("grp", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp"))
    keys = ["grp", "i", "j"]

    def task(batches):
        pivots = references()
        for (_, i, j), part, fp in _squares(batches):
            cols: dict[str, list] = {"a": [], "b": []}
            if i == j:
                found = square_links(fp, fp, pivots)
            else:
                found = square_links(fp[part == i], fp[part == j], pivots)
            if found:
                pairs = np.array(found, dtype=np.uint64).view(np.int64)
                cols["a"], cols["b"] = pairs[:, 0].tolist(), pairs[:, 1].tolist()
                yield out_batch(LINKS, cols)

    squares = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return squares.mapInArrow(task, LINKS)


def _large_groups(named: DataFrame, rows: int) -> DataFrame | None:
    """grp, parts of the groups of more than SQUARE members; None if there is none.

    Members are first counted over buckets of groups, about SQUARE / 4 members each, which combines
    well before the shuffle; only groups in buckets of more than SQUARE are counted one by one."""
    bucketed = named.withColumn("bucket", F.pmod(F.col("grp"), F.lit(max(1, 4 * rows // SQUARE))))
    full = written(bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SQUARE).select("bucket"), "full-buckets")
    if full.isEmpty():
        return None
    large = written(bucketed.join(full, "bucket").groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SQUARE)
                    .select("grp", F.ceil(F.col("n") / SQUARE).cast("int").alias("parts")), "large-groups")
    return None if large.isEmpty() else large


def _squares(batches):
    """((grp, i, j), part, fp) of every group of two rows or more, from rows that come sorted by it."""
    held = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "i", "j", "part", "fp")]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        grp, i, j, part, fp = now
        if not len(grp):
            held = None
            continue
        change = np.flatnonzero((grp[1:] != grp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        edges = np.concatenate(([0], change))
        last = int(edges[-1])
        for a, b in _several(edges):
            yield (grp[a], i[a], j[a]), part[a:b], fp[a:b].view(np.uint64)
        held = [x[last:] for x in now]
    if held is not None and len(held[0]) > 1:
        grp, i, j, part, fp = held
        yield (grp[0], i[0], j[0]), part, fp.view(np.uint64)


def _several(edges: np.ndarray) -> list[tuple[int, int]]:
    """Ranges between edges that hold two rows or more, but for the last, which is not complete."""
    wide = np.flatnonzero(np.diff(edges) > 1)
    return list(zip(edges[wide].tolist(), edges[wide + 1].tolist()))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row."""
    prints = written(fingerprints(documents), "fingerprints")
    by_print = rooted(prints)
    named = by_print.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(by_print.join(named, "root"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def rooted(prints: DataFrame) -> DataFrame:
    """fp, first (its smallest doc_id), root (the fingerprint that names its component) of every fingerprint."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    linked = components(links(distinct), "a", "b")
    return (distinct.join(linked, distinct["fp"] == linked["node"], "left")
            .select("fp", "first", F.coalesce("root", "fp").alias("root")))


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest doc_id (null ones last), then the smallest hash of
    its text; all columns kept.

    Rows are told apart by doc_id and text, so unrelated texts that share an id, or have none, all stay."""
    prints = written(fingerprints(documents, keyed=True), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "copies")
    found = prints.join(rooted(prints).select("fp", "root"), "fp").groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    kept = written(found.groupBy("root").agg(F.min(place).alias("kept")).select(
        F.col("kept.doc_id").alias("kept_id"), F.col("kept.digest").alias("kept_digest"), "kept.copies"), "kept")
    this = F.col("id").eqNullSafe(F.col("kept_id")) & F.col("digest").eqNullSafe(F.col("kept_digest"))
    out = packed(documents).join(kept.drop("copies"), this, "left_semi")
    repeated = kept.where("copies > 1")
    return unpacked(out if repeated.isEmpty() else out.dropDuplicates(["id", "digest"]), documents)
