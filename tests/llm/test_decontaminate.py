import hashlib
import random
import re

from pairjudge.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i:i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[key]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(3)
    vocabulary = ["alpha", "Béta", "gamma", "δ", "e1", "zeta", "x"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, say(30)), (2, "Short one, here"), (3, "solo"), (4, None), (5, ""), (10, say(10)), (11, say(12)), (None, say(14)), (1, "zz yy"), (7, "--- ...")]
    docs = [(i, say(rng.randint(0, 120))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "short ONE... here!"), (103, say(9) + " " + items[0][1] + " " + say(5)), (104, "solo"), (104, "solo"),
             (None, items[5][1].upper()), (105, "w " * 400_000 + items[0][1]), (106, "y" * 3_000_000 + " solo"), (107, " ".join(items[6][1].split()[:9]))]
    return docs, items


def rows(df):
    return sorted((tuple(r) for r in df.drop("ranges").collect()), key=str)


def test_matches_brute_force(spark, docs):
    given, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS window", "'q' AS n")
    expected = brute(given, items)
    assert rows(D.contamination(docs(given), benchmark)) == expected
    assert rows(D.contamination(docs(given), benchmark, block_windows=20)) == expected  # several blocks of windows


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(docs([]), none).count() == 0
    assert [tuple(r)[:4] for r in D.contamination(docs([(1, "a b")]), none).collect()] == [(1, 2, 0, 0)]


def test_stage_drops_contaminated_only(spark, docs):
    benchmark = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    source = docs([(1, "zero two three four five six seven eight nine ten eleven"), (2, "two three four five six seven eight nine ten"), (None, "one")])
    kept = D.drop_contaminated(source, benchmark)
    assert kept.columns == source.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]


def test_winnowing_guarantee():
    rng = random.Random(5)
    text = " ".join(rng.choice("abcdefgh") for _ in range(400))
    one, two = D.Words(text.encode()), D.Words(b"p q r " + text.encode())
    assert (one.fingerprints() == two.fingerprints()[3:]).all()


def test_stage_drops_rows_not_ids(spark, docs):
    benchmark = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    bad = "zero one two three four five six seven eight nine ten"
    kept = D.drop_contaminated(docs([(None, bad), (None, "clean text"), (None, None), (4, bad), (4, "clean as well")]), benchmark)
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == [("4", "clean as well"), ("None", "None"), ("None", "clean text")]


def test_last_piece_of_a_long_item_is_no_short_item(spark, docs):
    item = " ".join(f"w{i}" for i in range(200_000)) + " ." * (1 << 20)
    benchmark = spark.createDataFrame([("long", item)], "item_id string, text string")
    last = " ".join(f"w{i}" for i in range(199_991, 200_000))
    found = {r.doc_id: r.n_hit for r in D.contamination(docs([(1, f"x {last} y"), (2, f"w199990 {last} y")]), benchmark).collect()}
    assert found == {1: 0, 2: 10}


def test_copies_are_rows_each_over_several_blocks(spark, docs):
    items = [(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(6)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    given = [(7, f"{items[0][1]} and {items[5][1]}")] * 50 + [(None, None)] * 20 + [(None, items[3][1])] * 3 + [(8, "clean")]
    assert rows(D.contamination(docs(given), benchmark, block_windows=4)) == brute(given, items)
