import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pairjudge.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def by_hand(rows):
    """(doc_id, leaf, subroot, root, proof_sha256) of every row by plain recursion."""
    parts = {}
    for r in rows:
        parts.setdefault((r[3] is not None, (r[3] or "").encode()), []).append(((r[0] is not None, r[0] or 0), H(*map(field, (r[0], r[3], r[2], r[4], r[1]))), r[0]))

    def tree(nodes):
        proofs = [""] * len(nodes)
        members = [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            up, groups = [], []
            for at in range(0, len(nodes), 16):
                run = nodes[at:at + 16]
                for k in range(len(run)):
                    for m in members[at + k]:
                        proofs[m] += "".join(run[:k] + run[k + 1:])
                up.append(H(*run))
                groups.append([m for g in members[at:at + 16] for m in g])
            nodes, members = up, groups
        return nodes[0], proofs

    tops = []
    for key in sorted(parts):
        rows_ = sorted(parts[key])
        tops.append((rows_, *tree([leaf for _, leaf, _ in rows_])))
    root, outer = tree([top for _, top, _ in tops])
    return sorted(((doc, leaf, top, root, H(p + outer[i])) for i, (rows_, top, proofs) in enumerate(tops)
                   for (_, leaf, doc), p in zip(rows_, proofs)), key=str)


def rows_of(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def table(docs, seed=1):
    rnd = random.Random(seed)
    pairs = [(i, f"Text {i} É\n" * (i % 4), rnd.choice(["en", None]), rnd.choice(["hot"] * 6 + ["a", "ß", None, "Z"])) for i in range(700)]
    pairs += [(None, "No id", "en", "hot"), (None, None, None, None), (7, "again", "en", "a"), (7, "again", "en", "a"), (8, "", None, "only"), (9, "x" * 300_000, "en", "long")]
    rnd.shuffle(pairs)
    return docs(pairs)


@pytest.mark.parametrize("levels", [1, 3])  # blocks of 16 nodes take the table through three phases
def test_against_plain_recursion(spark, docs, levels):
    df = table(docs)
    out = merkle.manifest(df, levels=levels)
    assert rows_of(out) == by_hand([tuple(r) for r in df.collect()])
    assert all(r.verified and r.folded_root == r.root for r in out.collect())


def test_heap_of_many_levels():
    for n, levels in ((1, 0), (1, 2), (5, 1), (16, 1), (17, 2), (300, 3), (4096, 3)):
        nodes = [H(str(i)) for i in range(n)]
        top, got = merkle.forward(nodes, levels)
        proofs = dict(merkle.backward(got, levels, "end"))
        assert sorted(proofs) == list(range(n)) and all(p.endswith("end") for p in proofs.values())
        if levels == merkle.depth(n):
            assert all(merkle.fold(nodes[i], i, n, proofs[i]) == (top, len(proofs[i]) - 3) for i in range(n))


def test_tampering_is_seen(spark, docs):
    df = table(docs)
    out = {}
    for r in merkle.manifest(df, {"text": F.when(F.col("doc_id") % 5 == 0, F.lower("text")).otherwise(F.col("text"))}).collect():
        out.setdefault(r.doc_id, []).append(r.verified)
    for r in df.collect():
        changed = r.doc_id is not None and r.doc_id % 5 == 0 and r.text != r.text.lower()
        assert out[r.doc_id] == [not changed] * len(out[r.doc_id])


def test_one_row_and_none(spark, docs):
    r, = merkle.manifest(docs([(3, "x", None, "s")])).collect()
    assert r.root == r.subroot == r.leaf and r.proof_sha256 == H("") and r.verified
    assert merkle.manifest(docs([(3, "x")]).limit(0)).collect() == []


def test_equal_rows_without_id_are_dealt_out(spark, docs):
    df = docs([(None, "same", "en", "hot")] * 900)
    assert rows_of(merkle.manifest(df)) == by_hand([tuple(r) for r in df.collect()])
