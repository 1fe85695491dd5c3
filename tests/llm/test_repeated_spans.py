import random

from pairjudge.llm import repeated_spans as R


def brute(rows):
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        units = R.sentences(text or "")
        gone = set()
        for i in range(len(units)):
            j, held = i, []
            while j < len(units) and (len(held) < R.WORDS or j - i < R.SENTENCES):
                held += units[j][2]
                j += 1
            if len(held) < R.WORDS or j - i < R.SENTENCES:
                break
            key = " ".join(held)
            if key in seen:
                gone.update(range(i, j))
            seen[key] = True
        out[doc] = None if text is None else "".join(text[a:b] for k, (a, b, _) in enumerate(units) if k not in gone)
    return out


def corpus():
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 30))
    say = lambda n: " ".join(word() + rng.choice(["", "", "", ".", "!", "?\n"]) for _ in range(n))
    passages = [say(60), say(80), " ".join(word() for _ in range(90))]
    rows = []
    for i in range(80):
        parts = [say(rng.randint(0, 60)) for _ in range(3)]
        if i % 3:
            parts.insert(rng.randint(0, 3), "\n" + rng.choice(passages) + "\n")
        rows.append((i, ". ".join(parts)))
    return rows + [(100, None), (101, ""), (102, rows[5][1]), (None, rows[6][1]), (103, "?!. \n .. " * 1000), (104, "one. two. " * 30_000)], passages


def test_matches_brute_force_and_passages_remain_once(docs):
    rows, passages = corpus()
    found = {r.doc_id: r.text for r in R.remove_repeats(docs(rows)).collect()}
    assert found == brute(rows)
    for passage in passages:
        middle = passage.split()[25:40]
        assert sum(" ".join(middle) in (t or "") for t in found.values()) <= 1


def test_sentences_cover_the_text():
    for _, text in corpus()[0]:
        assert "".join(text[a:b] for a, b, _ in R.sentences(text or "")) == (text or "")


def test_repeated_rows_are_one_document(docs):
    text = " ".join(f"Sentence {n} of this text has eight words." for n in ("one", "two", "three", "four", "five"))
    found = [r.text for r in R.remove_repeats(docs([(1, text), (1, text), (2, text)])).orderBy("doc_id").collect()]
    assert found == [text, text, ""]


def test_empty_table(docs):
    assert R.remove_repeats(docs([])).count() == 0


def test_every_shared_stretch_of_51_words_holds_a_run(docs):
    rng = random.Random(51)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 200))

    def say(n, full_stops):
        return " ".join(word() + (rng.choice(".!?") if rng.random() < full_stops else "") for _ in range(n))

    rows, planted = [], []
    for i in range(300):
        passage = say(51, rng.choice([0, 0, 0.04, 0.1]))
        planted.append(passage.split())
        rows += [(2 * i + j, " ".join([say(rng.randint(1, 40), 0.05), passage, say(rng.randint(1, 40), 0.05)])) for j in (0, 1)]
    # Plain search: both texts hold the passage as a window of words.
    for (_, a), (_, b), passage in zip(rows[::2], rows[1::2], planted):
        windows = [{tuple(w[i:i + 51]) for i in range(len(w) - 50)} for w in (a.split(), b.split())]
        assert tuple(passage) in windows[0] & windows[1]
    found = {r.doc_id: r for r in R.remove_repeats(docs(rows)).collect()}
    assert all(found[2 * i].n_removed == 0 and found[2 * i + 1].n_removed > 0 for i in range(300))


def test_sentences_inside_running_text_and_lines(docs):
    rng = random.Random(18)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 200))
    say = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(100):
        sizes, between = [((18, 18, 18), " "), ((24, 24, 24), " "), ((24, 27), "\n")][i % 3]
        passage = ". ".join(say(n) for n in sizes)
        rows += [(2 * i + j, say(10) + between + passage + between + say(10)) for j in (0, 1)]
    assert all(r.n_removed > 0 for r in R.remove_repeats(docs(rows)).collect() if r.doc_id % 2)
