"""PII surrogates: keyed, type-consistent replacements.

Entities: e-mail addresses, telephone numbers, IPv4 addresses, payment cards (13 to 19 digits that pass
the Luhn check), US social security numbers, IBANs, and persons introduced by a title. Telephone numbers are those with + or a
trunk 0, with an area code in brackets, ten digits of the North American plan, or three groups and more; 7 to 15 digits in all,
and of several readings the longest. A name is up to four words with a capital first letter of any script, initials and all capitals included.

Each entity has a canonical form (digits of a number, lower-cased address, name without title), so every spelling of it
gets the same surrogate, in every document: coreference stays. A surrogate keeps type and format: as many
digits in the same places, the country code, Luhn and IBAN checks valid, dots and signs where they were; a person's keeps
the gender, the script, the number of words, initials and the case. The gender of a name is that of its titles in all documents; where they
tell none, or both, it is neutral.

Numbers are mapped by a keyed Feistel permutation of all numbers of their length (walking the cycle past
those that are not valid), so two numbers never share a surrogate. Names and addresses are spelled from a
keyed hash; those that collide are found by Spark over all distinct entities and get further syllables,
round after round, until all differ. A last count checks that there are as many surrogates as entities.

Plan: one pass finds the entities of every text, the collision rounds run on the distinct ones, a second pass writes
the texts. Entities that were respelled, and names whose titles differ, are joined back to the texts that mention them
(by a hash of the text: texts of equal hash share a list, in which each looks up its own entities). How many they are changes no
surrogate: all names start with ``SYLLABLES``, and only those that collide get more.

Defined results: null texts stay null; overlapping matches go to the first kind in ``KINDS``; repeated rows
are rewritten each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairjudge.llm.common import out_batch, slices, strings, written

KEY = b"pairjudge-surrogates"
#: Syllables of a name or of an address's local part, before collisions add any.
SYLLABLES = 4

#: Titles with the gender they tell.
TITLES = {"mr": "m", "mister": "m", "sir": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "signor": "m", "господин": "m", "κύριος": "m",
          "mrs": "f", "ms": "f", "miss": "f", "madam": "f", "frau": "f", "madame": "f", "mme": "f", "señora": "f", "sra": "f", "signora": "f",
          "госпожа": "f", "κυρία": "f", "dr": "n", "prof": "n", "professor": "n"}
#: Endings that keep a first name's gender, by script.
ENDINGS = {"latin": {"m": ("o", "us", "ar"), "f": ("a", "ia", "ina"), "n": ("in", "el", "is")},
           "cyrillic": {"m": ("ан", "ир", "ей"), "f": ("а", "ия", "ина"), "n": ("и", "о", "е")},
           "greek": {"m": ("ος", "ης", "ας"), "f": ("α", "η", "ια"), "n": ("ι", "ο", "ου")}}
ONSETS = {"latin": "b d f g k l m n p r s t v z".split(), "cyrillic": "б в г д з к л м н п р с т ф".split(), "greek": "β γ δ ζ κ λ μ ν π ρ σ τ φ χ".split()}
VOWELS = {"latin": "a e i o u".split(), "cyrillic": "а е и о у".split(), "greek": "α ε ι ο υ".split()}

_TITLE = "|".join(sorted((re.escape(t) for t in TITLES), key=len, reverse=True))
_LETTER = r"[^\W\d_][\u0300-\u036F]*"
_NAME = re.compile(rf"\x20*({_LETTER}\.|{_LETTER}(?:['’-]?{_LETTER})*)(?!\w)")
NAME_WORDS = 4
#: Country codes of one and two digits (fixed values); all others have three.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_PHONES = [re.compile(rf"(?<![\w.+-]){p}(?![\w-])") for p in (
    r"\+[0-9]+(?:[ .-]?\([0-9]{1,5}\))?(?:[ ./-]?[0-9]+)*", r"\([0-9]{2,5}\)[ .-]?[0-9]+(?:[ .-][0-9]+)*", r"0[0-9]{1,5}(?:[ /-][0-9]{2,8}){1,4}", r"0[0-9]{9,11}",
    r"[2-9][0-9]{2}[2-9][0-9]{6}",
    r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{2,4}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4})?")]
KINDS = ("email", "iban", "card", "ssn", "ip", "phone", "person")
PATTERNS = {
    "email": re.compile(r"(?<![\w.+-])[A-Za-z0-9_](?:[\w.+-]{0,62}[\w+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![\w-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![\w]|\.[0-9])"),
    "person": re.compile(rf"(?<!\w)(?i:{_TITLE})\.?\x20+(?=[^\W\d_])"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def entities(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, canonical form, detail) of the entities, in order; the detail of a person is
    the gender, for the others it is empty. No two overlap."""
    taken: list[tuple[int, int, str, str, str]] = []
    for kind in KINDS:
        if (kind in ("card", "ssn", "ip", "phone", "iban") and not _DIGITS.search(text)) or (kind == "email" and "@" not in text):
            continue
        for m in _matches(kind, text):
            start, end, detail = m.start(), m.end(), ""
            if kind == "person":
                start, end = end, _name_end(text, end)
                if start == end:
                    continue
                detail = TITLES[m[0].strip(" .").lower()]
                canonical = unicodedata.normalize("NFC", text[start:end]).lower()
            elif kind == "email":
                canonical = m[0].lower()
            elif kind == "ip":
                canonical = m[0]
            else:
                canonical = re.sub(r"[^A-Z0-9]", "", m[0])
                if (kind == "card" and not luhn(canonical)) or (kind == "iban" and not (15 <= len(canonical) <= 34 and iban(canonical))):
                    continue
                if kind == "phone":
                    if not 7 <= len(canonical) <= 15 or _DATE.fullmatch(m[0]):
                        continue
                    if m[0].startswith("+"):
                        detail = "+" + country(canonical)
            taken.append((start, end, kind, canonical, detail))
    out: list[tuple[int, int, str, str, str]] = []
    for found in sorted(taken, key=lambda x: (x[0], KINDS.index(x[2]), -x[1])):
        if not out or found[0] >= out[-1][1]:
            out.append(found)
        elif KINDS.index(found[2]) < KINDS.index(out[-1][2]):
            out[-1] = found
    return out


def _matches(kind: str, text: str) -> Iterator[re.Match]:
    for pattern in _PHONES if kind == "phone" else [PATTERNS[kind]]:
        yield from pattern.finditer(text)


def _name_end(text: str, start: int) -> int:
    """Where the name that begins at ``start`` ends: after words with a capital first letter, not all of them initials."""
    at = end = start
    for _ in range(NAME_WORDS):
        m = _NAME.match(text, at)
        if m is None or not m[1][0].isupper() or (at > start and m.start(1) - at != 1):
            break
        at = m.end()
        if not m[1].endswith("."):
            end = at
    return end


def country(number: str) -> str:
    return next((number[:n] for n in (1, 2) if number[:n] in SHORT_CODES), number[:3])


_DIGITS = re.compile(r"[0-9]")
_DATE = re.compile(r"[0-9]{4}[ .-][0-9]{2}[ .-][0-9]{2}|[0-9]{2}[ .-][0-9]{2}[ .-][0-9]{4}")


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.digest(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256)[:16], "big")


def permuted(value: int, modulus: int, key: bytes, label: str) -> int:
    """Keyed permutation of 0..modulus - 1: a Feistel network on two halves, cycles walked."""
    side = 1
    while side * side < modulus:
        side += 1 + side // 2
    while True:
        left, right = divmod(value, side)
        for i in range(6):
            left, right = right, (left + _number(key, label, side, i, right)) % side
        value = left * side + right
        if value < modulus:
            return value


def digits(canonical: str, key: bytes, label: str, valid=lambda d: True) -> str:
    """Surrogate of a string of digits: the next valid one on its cycle."""
    n, value = len(canonical), int(canonical)
    while True:
        value = permuted(value, 10 ** n, key, f"{label}{n}")
        if valid(out := str(value).zfill(n)):
            return out


def script(text: str) -> str:
    for c in text:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
    return "latin"


def spelled(number: int, syllables: int, alphabet: str) -> str:
    out = ""
    for _ in range(syllables):
        number, c = divmod(number, len(ONSETS[alphabet]))
        number, v = divmod(number, len(VOWELS[alphabet]))
        out += ONSETS[alphabet][c] + VOWELS[alphabet][v]
    return out


def surrogate(kind: str, canonical: str, detail: str, key: bytes = KEY, syllables: int = SYLLABLES) -> str:
    """Canonical form of the surrogate."""
    if kind == "card":
        return digits(canonical, key, kind, luhn)
    if kind == "phone" and detail:
        return detail + digits(canonical[len(detail) - 1:], key, kind + detail)
    if kind in ("ssn", "phone"):
        return digits(canonical, key, kind)
    if kind == "ip":
        value = 0
        for part in canonical.split("."):
            value = value * 256 + int(part)
        value = permuted(value, 1 << 32, key, kind)
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
    if kind == "iban":
        country, body = canonical[:2], canonical[4:]
        number = permuted(int(body, 36), 36 ** len(body), key, f"{kind}{len(body)}") if not body.isdigit() else int(digits(body, key, kind))
        new = _base36(number, len(body)) if not body.isdigit() else str(number).zfill(len(body))
        rest = int("".join(str(int(c, 36)) for c in new + country + "00")) % 97
        return f"{country}{98 - rest:02d}{new}"
    if kind == "email":
        local, _, domain = canonical.partition("@")
        number = _number(key, kind, canonical)
        tail = re.search(r"[0-9]*$", local)[0]
        name = spelled(number, syllables, "latin")
        if tail:
            name += "".join(str(_number(key, "tail", canonical, i) % 10) for i in range(len(tail)))
        return f"{name}@{spelled(_number(key, 'domain', domain), 3, 'latin')}.example"
    alphabet = script(canonical)
    words = canonical.split(" ")
    number, new = _number(key, kind, canonical), []
    for i, word in enumerate(words):
        if word.endswith("."):
            number, c = divmod(number, len(ONSETS[alphabet]))
            new.append(ONSETS[alphabet][c] + ".")
            continue
        number, ending = divmod(number, len(ENDINGS[alphabet]["n"]))
        base = spelled(number, max(1, syllables // (1 if len(words) == 1 else 2)), alphabet)
        number //= (len(ONSETS[alphabet]) * len(VOWELS[alphabet])) ** max(1, syllables // 2)
        new.append(base + ENDINGS[alphabet][detail if not i else "n"][ending])
    return " ".join(new)


def _base36(number: int, n: int) -> str:
    out = ""
    for _ in range(n):
        number, d = divmod(number, 36)
        out = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[d] + out
    return out


def formatted(kind: str, original: str, new: str) -> str:
    """The surrogate in the original's format: its separators, or the case of its words."""
    if kind in ("card", "ssn", "phone", "iban"):
        left = iter(new.lstrip("+"))
        return "".join(next(left) if c.isascii() and c.isalnum() else c for c in original)
    if kind == "person":
        old, words = original.split(" "), new.split(" ")
        return " ".join(w.upper() if o.isupper() else w.capitalize() for o, w in zip(old, words, strict=True))
    return new


FOUND = T.StructType([T.StructField("kind", T.StringType()), T.StructField("canonical", T.StringType()), T.StructField("detail", T.StringType())])
MENTION = T.StructType([T.StructField("text_hash", T.LongType()), *FOUND.fields])
SPELLED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("canonical", T.StringType()), T.StructField("own", T.StringType()),
                        T.StructField("detail", T.StringType()), T.StructField("mixed", T.BooleanType()), T.StructField("extra", T.IntegerType()),
                        T.StructField("new", T.StringType())])
REWRITTEN = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_entities", T.LongType()),
                          *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("spans", T.StringType())])


#: Tells entities with the same canonical form apart: the country of a telephone number, nothing for a person, who has one detail only.
OWN = "CASE WHEN kind = 'person' THEN '' ELSE detail END"


def mentions(documents: DataFrame) -> DataFrame:
    """The entities of every text, once each, with ``text_hash``."""

    def task(batches):
        for batch in slices(batches):
            cols: dict[str, list] = {f.name: [] for f in MENTION}
            for key, text in zip(strings(batch.column("text_hash")), strings(batch.column("text"))):
                for kind, canonical, detail in dict.fromkeys(found[2:] for found in entities(text or "")):
                    cols["text_hash"].append(key)
                    cols["kind"].append(kind)
                    cols["canonical"].append(canonical)
                    cols["detail"].append(detail)
            yield out_batch(MENTION, cols)

    return documents.select(F.xxhash64("text").alias("text_hash"), "text").mapInArrow(task, MENTION)


def told(found: DataFrame) -> DataFrame:
    """Entities, one row each, with the one detail they have: the gender that a name's titles agree on (``mixed``: titles differ)."""
    male, female = F.col("male") & ~F.col("female"), F.col("female") & ~F.col("male")
    return found.groupBy("kind", "canonical", F.expr(OWN).alias("own")).agg(
        F.bool_or(F.col("detail") == "m").alias("male"), F.bool_or(F.col("detail") == "f").alias("female"),
        (F.min("detail") != F.max("detail")).alias("mixed")).select(
            "kind", "canonical", "own", F.when(F.col("kind") != "person", F.col("own")).when(male, "m").when(female, "f").otherwise("n").alias("detail"), "mixed")


def _spell(entity: DataFrame, key: bytes, syllables: int) -> DataFrame:
    """Adds ``new``, spelled with ``extra`` syllables more."""

    def task(batches):
        for batch in batches:
            cols = {f.name: strings(batch.column(f.name)) for f in SPELLED if f.name != "new"}
            cols["new"] = [surrogate(k, c, d, key, syllables + e) for k, c, d, e in zip(*(cols[n] for n in ("kind", "canonical", "detail", "extra")))]
            yield out_batch(SPELLED, cols)

    return entity.mapInArrow(task, SPELLED)


def told_apart(found: DataFrame, key: bytes, syllables: int) -> DataFrame:
    """Entities, one row each, with ``extra``, the syllables more that they need for a surrogate of their own."""
    state = written(_spell(told(found).withColumn("extra", F.lit(0)), key, syllables), "surrogates")
    while True:
        # Of entities with the same surrogate, the smallest keeps it.
        who = F.struct("canonical", "own")
        kept = state.groupBy("kind", "new").agg(F.min(who).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        clash = written(state.join(kept, ["kind", "new"]).where(who != F.col("kept")).select(*state.drop("new").columns), "collisions")
        if clash.isEmpty():
            return state
        rest = state.join(clash.select("kind", "canonical", "own"), ["kind", "canonical", "own"], "left_anti")
        again = _spell(clash.withColumn("extra", F.col("extra") + 1), key, syllables)
        state = written(rest.select(*state.columns).unionByName(again), "surrogates")


def respelled(found: DataFrame, key: bytes = KEY, most: int | None = None) -> tuple[int, int, dict[tuple[str, str, str], int], dict[str, str]]:
    """For a look at small tables, on the driver: syllables that all names start with, the number of entities, those that need more syllables with how
    many more, and the genders of names whose titles differ. With ``most``, all names start with so many syllables that no more than that need more.

    ``replace_pii`` does not use it: its names start with ``SYLLABLES``, and nothing of it goes through the driver."""
    syllables = SYLLABLES
    while True:
        state = told_apart(found, key, syllables)
        changed = state.where("extra > 0")
        if most is None or changed.count() <= most:
            genders = {r["canonical"]: r["detail"] for r in state.where("mixed").collect()}
            return syllables, state.count(), {(r["kind"], r["canonical"], r["detail"]): r["extra"] for r in changed.collect()}, genders
        syllables += 1


def exceptions(mentioned: DataFrame, state: DataFrame) -> DataFrame:
    """By ``text_hash``, the mentions that are not spelled as they stand: of another detail than their title tells, or with syllables more."""
    changed = written(state.where("extra > 0 OR mixed").select("kind", "canonical", "own", F.col("detail").alias("use"), "extra"), "changed")
    found = mentioned.withColumn("own", F.expr(OWN)).join(changed, ["kind", "canonical", "own"]).where("extra > 0 OR use != detail")
    return found.groupBy("text_hash").agg(F.collect_set(F.struct("kind", "canonical", "detail", "use", "extra")).alias("exceptions"))  # those of one text


def rewrite(text: str, changed: dict[tuple[str, str, str], tuple[str, int]], key: bytes = KEY,
            syllables: int = SYLLABLES) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and (start, end, kind) of what was replaced in the original; ``changed`` has the detail and the syllables more of
    entities that are not spelled as they stand."""
    parts, at, spans = [], 0, []
    for start, end, kind, canonical, detail in entities(text):
        detail, extra = changed.get((kind, canonical, detail), (detail, 0))
        new = surrogate(kind, canonical, detail, key, syllables + extra)
        parts += [text[at:start], formatted(kind, text[start:end], new)]
        spans.append((start, end, kind))
        at = end
    return "".join([*parts, text[at:]]), spans


def replace_pii(documents: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, text with surrogates, entities by kind and where they were, of every row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    syllables = SYLLABLES
    mentioned = written(mentions(docs), "mentions")
    lists = written(exceptions(mentioned, told_apart(mentioned, key, syllables)), "exceptions")

    def task(batches):
        for batch in slices(batches):
            cols: dict[str, list] = {f.name: [] for f in REWRITTEN}
            for doc, text, listed in zip(*(strings(batch.column(c)) for c in ("doc_id", "text", "exceptions"))):
                changed = {(e["kind"], e["canonical"], e["detail"]): (e["use"], e["extra"]) for e in listed or ()}
                new, spans = rewrite(text or "", changed, key, syllables)
                kinds = [k for _, _, k in spans]
                cols["doc_id"].append(doc)
                cols["text"].append(None if text is None else new)
                cols["n_entities"].append(len(spans))
                for k in KINDS:
                    cols[f"n_{k}"].append(kinds.count(k))
                cols["spans"].append(",".join(f"{k}:{a}:{b}" for a, b, k in spans))
            yield out_batch(REWRITTEN, cols)

    return docs.withColumn("text_hash", F.xxhash64("text")).join(lists, "text_hash", "left").drop("text_hash").mapInArrow(task, REWRITTEN)
