from pairjudge.llm import pii as P

TEXT = ("Mr. John Smith met Frau Müller-Lüdenscheidt and госпожа Анна Петрова, call +1 (555) 555-5254. Write to a.b12@mail6.example.com from "
        "192.168.0.1; card 4111 1111 1111 1111 or 4111111111111111, iban DE89 3704 0044 0532 0130 00, ssn 123-45-6789. Mr John Smith again; A.B12@mail6.example.com.")


def test_format_type_and_coreference():
    new, spans = P.rewrite(TEXT, {})
    assert [k for _, _, k in spans] == ["person", "person", "person", "phone", "email", "ip", "card", "card", "iban", "ssn", "person", "email"]
    found = P.entities(new)
    assert [k for _, _, k, _, _ in found] == ["person", "person", "person", "phone", "email", "ip", "card", "card", "iban", "ssn", "person", "email"]
    old = P.entities(TEXT)
    for i in range(len(old)):
        for j in range(len(old)):
            assert (old[i][3] == old[j][3]) == (found[i][3] == found[j][3])
        assert old[i][3] != found[i][3] and old[i][4] == found[i][4]  # the gender is the same
    assert P.script(found[2][3]) == "cyrillic" and P.luhn(found[6][3]) and P.iban(found[8][3])
    assert P.rewrite(TEXT, {}, b"another key")[0] != new


def test_numbers_are_permuted():
    assert len({P.permuted(i, 1000, b"k", "x") for i in range(1000)}) == 1000
    assert len({P.digits(f"{i:03d}", b"k", "x") for i in range(1000)}) == 1000


def test_collisions_are_respelled(spark, monkeypatch):
    monkeypatch.setattr(P, "SYLLABLES", 1)
    rows = [("person", f"name{i}", "m") for i in range(120)] + [("email", f"user{i}@x.org", "") for i in range(120)]
    found = spark.createDataFrame(rows, P.FOUND)
    syllables, _, extra, _ = P.respelled(found)
    assert extra  # one syllable is too few for so many
    new = [(k, P.surrogate(k, c, d, P.KEY, syllables + extra.get((k, c, d), 0))) for k, c, d in rows]
    assert len(set(new)) == len(rows)
    longer, _, few, _ = P.respelled(found, most=10)
    assert longer > 1 and len(few) <= 10


def test_rows(docs):
    rows = [(1, TEXT), (1, TEXT), (2, None), (3, ""), (None, "no one here"), (4, "x " * 200_000 + "call 555-555-5254")]
    found = {r.doc_id: r for r in P.replace_pii(docs(rows)).collect()}
    assert found[1].n_entities == 12 and found[1].n_person == 4 and found[2].text is None and found[3].text == "" and found[None].text == "no one here"
    assert found[4].n_phone == 1 and "555-555-5254" not in found[4].text and found[4].text.startswith("x x ")
    assert P.replace_pii(docs([])).count() == 0


def test_clean_text_stays():
    for text in ["version 1.2.3 of 2024-01-02", "16 digits 1234567890123456 fail the check", "Mr. went home", "a@b", "1.2.3.4.5", "ISBN 978-3"]:
        assert P.rewrite(text, {})[0] == text


PHONES = ["+15555551234", "5555551234", "+49 170 1234567", "0171 1234567", "030 12345678", "+33 6 12 34 56 78", "+1 (555) 555-5254", "(030) 1234567", "01711234567", "+44 20 7946 0958"]
NAMES = ["McDonald", "O'Neill", "J. Smith", "SMITH", "Žižek", "Wałęsa", "J. R. Smith-Jones", "D’Angelo", "Łukasz Żółć", "Иван Петров", "Müller"]


def test_phones_are_replaced_whole():
    for phone in PHONES:
        new, spans = P.rewrite(f"call {phone}, please", {})
        assert spans == [(5, 5 + len(phone), "phone")], phone
        shown = new[5:-8]
        assert shown != phone and [c for c in shown if not c.isdigit()] == [c for c in phone if not c.isdigit()] and len(shown) == len(phone)
        if phone.startswith("+"):  # the country code stays
            digits = [c for c in phone if c.isdigit()]
            n = len(P.country("".join(digits)))
            assert [c for c in shown if c.isdigit()][:n] == digits[:n]
    assert len({P.rewrite(f"call {p}", {})[0] for p in PHONES}) == len(PHONES)
    for text in ["0.1234567 percent", "in 2020-01-02 and 1234567890", "order 12345", "10 000 000 people"]:
        assert not [s for s in P.rewrite(text, {})[1] if s[2] == "phone" and text.startswith(("0.", "in", "order"))]


def test_names_after_a_title():
    for name in NAMES:
        new, spans = P.rewrite(f"met Mr. {name} today", {})
        assert spans == [(8, 8 + len(name), "person")], name
        shown = new[8:-6]
        assert shown.lower() != name.lower() and len(shown.split(" ")) == len(name.split(" ")) and shown.isupper() == name.isupper()
    assert P.rewrite("Mr. J. went", {})[0] == "Mr. J. went" and P.rewrite("Dr. smith", {})[0] == "Dr. smith"


def test_one_surrogate_per_name_whatever_the_title(docs):
    rows = [(1, "Dr. Anna Smith"), (2, "Mrs. Anna Smith"), (3, "Mr. Kim Lee"), (4, "Ms. Kim Lee"), (5, "Dr. ANNA SMITH"), (6, "Dr. Jo Fox")]
    found = {r.doc_id: r.text.split(" ", 1)[1] for r in P.replace_pii(docs(rows)).collect()}
    assert found[1] == found[2] and found[3] == found[4] and found[5] == found[1].upper() and len({found[1], found[3], found[6]}) == 3
    assert found[1].split(" ")[0].lower().endswith(P.ENDINGS["latin"]["f"])


def test_no_surrogate_depends_on_how_many_are_respelled(docs, monkeypatch):
    monkeypatch.setattr(P, "SYLLABLES", 1)
    monkeypatch.setattr(P.respelled, "__defaults__", (P.KEY, 10))  # a bound that the respelled and the names of several titles pass
    names = [a + b + c for a in "ABCDEFG" for b in "aeiou" for c in ("nak", "rot", "lif", "sum", "tep", "gov", "dil", "kar")]
    gender = {n: "m" if i % 3 else "f" for i, n in enumerate(names)}
    title = {"m": "Mr.", "f": "Mrs."}
    rows = [(i, ", ".join(f"Dr. {n}" for n in names[i::7])) for i in range(7)] + [(10 + i, f"{title[gender[n]]} {n}") for i, n in enumerate(names)]
    extra = dict.fromkeys(names, 0)
    while True:
        new = {n: P.surrogate("person", n.lower(), gender[n], P.KEY, 1 + extra[n]) for n in names}
        kept = {}
        for n in sorted(names, key=str.lower):
            kept.setdefault(new[n], n)
        losers = [n for n in names if kept[new[n]] != n]
        if not losers:
            break
        for n in losers:
            extra[n] += 1
    assert sum(e > 0 for e in extra.values()) > 10
    found = {r.doc_id: r.text for r in P.replace_pii(docs(rows + rows)).collect()}
    assert found == {**{i: ", ".join(f"Dr. {new[n].capitalize()}" for n in names[i::7]) for i in range(7)},
                     **{10 + i: f"{title[gender[n]]} {new[n].capitalize()}" for i, n in enumerate(names)}}
