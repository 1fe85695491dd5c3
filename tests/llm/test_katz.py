import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pairjudge.llm import katz
from pairjudge.llm.common import pack, pack_keys, unpack, unpack_keys


def tokens(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["\n"]


def is_held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


class Plain:
    """The same model by dictionaries of whole n-grams."""

    def __init__(self, rows, order):
        self.c = [Counter() for _ in range(order)]
        for doc, text in rows:
            if not is_held(doc):
                t = tokens(text)
                for k in range(1, order + 1):
                    padded = ["<s>"] * (k - 1) + t
                    self.c[k - 1].update(tuple(padded[i:i + k]) for i in range(len(t)))
        self.d = []
        for c in self.c:
            spectrum = Counter(min(v, 7) for v in c.values())
            self.d.append(katz.discounts([spectrum[r] for r in range(1, 7)]))
        self.n = sum(self.c[0].values())
        self.after = []
        for k in range(order):
            after = defaultdict(list)
            for g in self.c[k]:
                after[g[:-1]].append(g)
            self.after.append(after)

    def kept(self, g):
        c = self.c[len(g) - 1][g]
        return c * (self.d[len(g) - 1][c] if c <= katz.CUT else 1)

    def whole(self, h, k):
        total = sum(self.c[k - 1][g] for g in self.after[k - 1][h])
        left = total - sum(map(self.kept, self.after[k - 1][h]))
        return (total, left) if left > 0 else (total + 1, 1)

    def p(self, g):
        k = len(g)
        if k == 1:
            whole, left = self.whole((), 1)
            return self.kept(g) / whole if g in self.c[0] else left / whole
        if g in self.c[k - 1]:
            return self.kept(g) / self.whole(g[:-1], k)[0]
        seen = self.after[k - 1].get(g[:-1])
        if not seen:
            return self.p(g[1:])
        whole, left = self.whole(g[:-1], k)
        return left / whole / (1 - sum(self.p(s[1:]) for s in seen)) * self.p(g[1:])

    def score(self, text, order):
        t = ["<s>"] * (order - 1) + tokens(text)
        return sum(math.log10(self.p(tuple(t[i:i + order]))) for i in range(len(t) - order + 1))


def corpus(seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Hot"] * 200 + ["É", "a.b"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(40)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (None, "hot w1 new"), (403, "unseen words only"), (404, "hot " * 30_000), (405, "a\x85b\x1cc A\x0bB")]
    rows += [(406, "same row again")] * 3
    return rows


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_dictionaries(spark, docs, order, monkeypatch):
    monkeypatch.setattr(katz, "PART_TOKENS", 9000)  # several partitions
    rows = corpus()
    df = docs(rows).repartition(3)
    plain = Plain(rows, order)
    out = katz.score(df, order, block_bytes=4000).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(d) for d, _ in rows)
    text = {d: t for d, t in rows}
    n, v = plain.n, len(plain.c[0])
    for r in out:
        t = tokens(text[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (is_held(r.doc_id), len(t), n)
        assert r.n_known == sum((w,) in plain.c[0] for w in t)
        assert math.isclose(r.base_score, sum(math.log10((plain.c[0][w,] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert math.isclose(r.score, plain.score(text[r.doc_id], order), rel_tol=1e-9, abs_tol=1e-12), r


def test_plain_model_sums_to_one():
    plain = Plain(corpus(), 3)
    words = [g[0] for g in plain.c[0]] + ["not seen"]
    for h in [(), ("hot",), ("<s>",), ("<s>", "<s>"), ("hot", "hot"), ("w1", "hot"), ("not seen", "w1")]:
        assert math.isclose(sum(plain.p((*h, w)) for w in words), 1, rel_tol=1e-9)


def test_discounts():
    d = katz.discounts([100, 40, 20, 12, 8, 6])
    assert d[0] == 0 and all(0 < x < 1 for x in d[1:]) and len(d) == katz.CUT + 1
    assert katz.discounts([100, 40, 20, 12, 0, 0])[4] == 1 > katz.discounts([100, 40, 20, 12, 0, 0])[3]
    assert katz.discounts([0] * 6)[1] == 0.5


def test_nothing_to_learn_and_empty_table(spark, docs):
    held = [i for i in range(60) if is_held(i)][:2]
    out = katz.score(docs([(i, "some words") for i in held])).collect()
    assert [(r.score, r.base_score, r.train_tokens, r.n_known) for r in out] == [(0, 0, 0, 0)] * 2
    assert katz.score(docs([(1, "x")]).limit(0)).collect() == []


def test_packing_of_arrays():
    import numpy as np
    keys = np.array([0, 5, 2 ** 63, 2 ** 64 - 1], dtype=np.uint64)
    assert (unpack_keys(pack_keys(keys)) == keys).all() and len(unpack_keys(pack_keys(keys[:0]))) == 0
    assert (unpack(pack(keys), np.uint64) == keys).all()
