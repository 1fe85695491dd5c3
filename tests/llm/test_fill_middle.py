import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pairjudge.llm import fill_middle


def by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 50 else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(units), "spm" if h4 % 100 < 50 else "psm", len(p), len(m), out


LINE = ["", "é" * 700, "word " * 90, "日本語" * 200, "a\r\x0b\x85 b", "<P", "S>", "x"]


def texts():
    rnd = random.Random(4)
    shared = "\n".join(rnd.choice(LINE) + str(rnd.random()) for _ in range(40))
    pairs = [(i, "\n".join(rnd.choice(LINE) for _ in range(rnd.randrange(30))) + "\n" * rnd.randrange(3)) for i in range(150)]
    pairs += [(1000 + i, f"{i} " * i + shared + "tail") for i in range(30)]
    pairs += [(2000, None), (2001, ""), (2002, "\n"), (2003, "has <M> inside\nit"), (None, "no\nid\nat all"), (2004, "line\n" * 100_000), (2005, "z" * 400_000), (2006, "\n" * 5000),
              (1, "repeated id\n"), (1, "repeated id\n")]
    return pairs


def test_against_regular_expression(spark, docs):
    df = docs(texts())
    out = sorted((tuple(r) for r in fill_middle.transform(df).collect()), key=str)
    assert out == sorted((by_hand(r.doc_id, r.text) for r in df.collect()), key=str)


def test_round_trip_and_empty_table(spark, docs):
    df = docs(texts())
    back = fill_middle.transform(df).select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text"))
    assert sorted(map(str, (tuple(r) for r in back.collect()))) == sorted(str((r.doc_id, r.text or "")) for r in df.collect())
    assert fill_middle.transform(df.limit(0)).collect() == []


def test_chunks_follow_content_and_are_remembered():
    rnd = random.Random(5)
    shared = "".join(chr(rnd.choice([97, 98, 10, 0xE9, 0x65E5])) for _ in range(60_000)).encode()
    cache = fill_middle.Summaries()
    found = []
    for head in (b"", b"one head\n" * 50):
        data = head + shared
        lines = fill_middle.Lines(data, 0, len(data), fill_middle.chunk_ends(data), cache)
        assert lines.n == len(re.findall(rb"[^\n]*\n|[^\n]+", data))
        found.append([data[a:b] for a, b in lines.spans])
        assert b"".join(found[-1]) == data
        for a, b in lines.spans:
            data[a:b].decode()
    assert len(set(found[0]) & set(found[1])) > 0.9 * len(found[0])
    assert len(cache) < 1.2 * len(found[0])


@pytest.mark.parametrize("limit", [0, 4000])
def test_memory_starts_afresh(monkeypatch, limit):
    monkeypatch.setattr(fill_middle, "REMEMBERED", limit)
    cache, data = fill_middle.Summaries(), b"some line\n" * 5000
    for _ in range(2):
        assert fill_middle.Lines(data, 0, len(data), fill_middle.chunk_ends(data), cache).cut(4999) == (49990, 49990)
        assert cache.held <= limit + fill_middle.MOST


def test_rate_and_order():
    assert fill_middle.code_points("aé日\U0001F600".encode()) == 4 and fill_middle.code_points(("é" * 100).encode()) == 100
