import random
import re

import numpy as np
import xxhash

from pairjudge.llm import simhash as H


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = np.array([fingerprint(t) for _, t in rows], dtype=np.uint64)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4).tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((rows[i][0], f"{int(prints[i]):016x}", least.get(root(i))) for i in range(len(rows))), key=str)


def corpus():
    rng = random.Random(11)
    say = lambda n: [rng.choice(["ab", "Cd", "é", "fg", "hij", "kl"]) + str(rng.randint(0, 99)) for _ in range(n)]
    rows = []
    for _ in range(40):
        text = say(rng.randint(1, 300))
        for _ in range(rng.randint(1, 4)):
            copy = list(text)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "new"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    rows = list(enumerate(rows, 10))
    return rows + [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "a\xa0b"), (7, "word " * 100_000), (8, "word " * 100_000), (8, "word " * 100_000)]


def test_matches_brute_force(docs):
    rows = corpus()
    assert sorted((tuple(r) for r in H.near_duplicates(docs(rows)).collect()), key=str) == brute(rows)


def test_null_ids(docs):
    assert [tuple(r)[::2] for r in H.near_duplicates(docs([(None, "same words here now")] * 2)).collect()] == [(None, None)] * 2


def test_large_groups_are_split_and_lose_no_link(spark, monkeypatch):
    """A chain of fingerprints, each 4 bits from the next, in groups beyond the size of a square."""
    monkeypatch.setattr(H, "SQUARE", 16)
    rng = np.random.default_rng(1)
    chain, x = [], int(rng.integers(1 << 62))
    for _ in range(150):
        for b in rng.choice(24, 4, replace=False).tolist():  # stay in the first bits: the other blocks agree
            x ^= 1 << b
        chain.append(x)
    lone = [int(v) for v in rng.integers(1 << 62, size=200)]
    prints = spark.createDataFrame([(v,) for v in {*chain, *lone}], "fp long")
    from pairjudge.llm.components import components
    roots = {r["node"]: r["root"] for r in components(H.links(prints), "a", "b").collect()}
    assert len({roots[v] for v in chain}) == 1


def test_pivot_table_square_matches_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(1 << 63, size=40, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, size=(300, 5), dtype=np.uint64))
    prints = np.unique(np.bitwise_xor.reduce(np.concatenate([flips, base[rng.integers(0, 40, 300)][:, None]], axis=1), axis=1))
    parent = {int(p): int(p) for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in H.square_links(prints, prints, H.references()):
        assert int(a ^ b).bit_count() <= 4
        parent[max(root(a), root(b))] = min(root(a), root(b))
    for i in prints.tolist():
        for j in prints.tolist():
            if (i ^ j).bit_count() <= 4:
                assert root(i) == root(j)


def test_stage_keeps_one_of_each_group(docs):
    source = docs([(3, "a b c d e f"), (1, "A b c d e f"), (1, "A b c d e f"), (2, "quite another text of five words"), (None, "third text without any number")])
    kept = H.keep_one(source)
    assert kept.columns == source.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "None"]


def test_empty_table(docs):
    assert H.near_duplicates(docs([])).count() == 0 and H.keep_one(docs([])).count() == 0


def test_stage_keeps_unrelated_texts_that_share_an_id_or_have_none(docs):
    texts = ["first text about apples and pears", "second text on quite other things", "third one of neither kind at all"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[0]), (7, texts[2]), (7, "the seventh row with one more text"), (None, texts[2])]
    kept = sorted((str(r.doc_id), r.text) for r in H.keep_one(docs(rows)).collect())
    assert kept == sorted([("None", texts[0]), ("None", texts[1]), ("7", texts[2]), ("7", rows[4][1])])
