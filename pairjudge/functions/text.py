"""Column -> Column text, parsing and hashing functions.

All are native Spark expressions (whole-stage codegen friendly); no Python UDF anywhere.
Regexes use ``(?U)`` so ``\\s``, ``\\w`` and ``\\b`` follow Unicode like Python's ``re``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values that must equal the evaluated scripts' behaviour.
# ---------------------------------------------------------------------------------------------
# Terms counted as "English signal" in an answer (each is matched inside " " + lower(text) + " ").
ENGLISH_TERMS = [
    " the ", " and ", " or ", " with ", " without ", " depending ", " symptoms ",
    " breast ", " cancer ", " common ", " include ", " including ", " can vary ",
    " location ", " stage ", " lump ", " underarm ", " nipple ", " redness ",
    " scaliness ", " surgery ", " after surgery", " answer ", " question ",
]
# Role markers / template residue that mark a prompt artifact.
PROMPT_ARTIFACT_RE = r"(?i)(#\s*utente|#\s*assistente|^utente\s*:|^assistente\s*:|answer with empathy|colonna answer)"
# Boolean label spellings.
TRUE_WORDS = ["true", "1", "yes", "sì", "si", "aumento", "increase", "increased"]
FALSE_WORDS = ["false", "0", "no", "nessun aumento", "not increased", "non aumento"]
# Screening thresholds.
MIN_COMPLETE_CHARS = 25
SHRINK_MIN_ORIGINAL = 120
SHRINK_FLOOR = 60
SHRINK_RATIO = 0.45
ENGLISH_HEAVY_MIN_TERMS = 4
# Error classes of a failed model call, checked in this order.
AUTH_WORDS = ["invalid api key", "authentication", "unauthorized"]
QUOTA_WORDS = ["insufficient", "balance", "quota", "billing", "credits"]
RATE_WORDS = ["rate limit", "too many requests"]
# ---------------------------------------------------------------------------------------------

# Every character Python's str.strip() removes (derived by rule, not listed by hand).
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_text(x) -> Column:
    """NULL -> '' and Unicode whitespace stripped at both ends (Python ``str.strip``).

    ``btrim`` with an explicit character set is a plain scan, much cheaper than a regex on long
    texts."""
    return F.btrim(F.coalesce(_c(x), F.lit("")), F.lit(WHITESPACE))


def normalize_text(x) -> Column:
    """NULL -> '', CRLF / CR -> LF, then strip."""
    t = F.replace(F.replace(F.coalesce(_c(x), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.btrim(t, F.lit(WHITESPACE))


def parse_choice(raw, strict: bool = False) -> Column:
    """Verdict text -> 'A' / 'B' (first standalone letter), NULL when there is none.

    Default matches on the upper-cased text, so a standalone article "a" counts as A, as the
    evaluated scripts do. ``strict`` matches upper-case letters only.
    """
    t = normalize_text(raw)
    src = t if strict else F.upper(t)
    return F.nullif(F.regexp_extract(src, r"(?U)\b([AB])\b", 1), F.lit(""))


def parse_yes_no(raw) -> Column:
    """Verdict text -> 'Yes' / 'No' (first standalone word, any case), NULL when absent."""
    w = F.regexp_extract(F.lower(normalize_text(raw)), r"(?U)\b(yes|no)\b", 1)
    return F.nullif(F.initcap(w), F.lit(""))


def recover_choice(choice, raw) -> Column:
    """Keep a stored A/B choice; otherwise re-parse the raw reply."""
    c = _c(choice)
    return F.when(c.isin("A", "B"), c).otherwise(parse_choice(raw))


def _json_ok(t: Column) -> Column:
    """Is ``t`` one JSON object? A repeated field is allowed, as JSON readers do (the last one counts);
    the variant parser refuses it, so a text it refuses is also parsed as a one-element array."""
    listed = F.concat(F.lit("["), t, F.lit("]"))
    alone = F.json_array_length(listed) == 1  # NULL or 2 if anything follows the object
    read = F.from_json(listed, "array<map<string,string>>")[0].isNotNull() & ~t.rlike(r"[{,:]\s*'")
    whole = F.startswith(t, F.lit("{")) & F.endswith(t, F.lit("}"))
    return F.coalesce(whole & alone & (F.try_parse_json(t).isNotNull() | read), F.lit(False))


def json_block(raw) -> Column:
    """The reply itself when it is a JSON object, else its outermost ``{...}`` block when that is one;
    NULL for everything else (JSON strings, numbers and arrays too)."""
    t = strip_text(raw)
    block = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.when(_json_ok(t), t).when(_json_ok(block), block)


def json_field(raw, field: str) -> Column:
    return F.from_json(json_block(raw), f"`{field}` string")[field]


def mismatch_explanation(raw) -> Column:
    """``mismatch_explanation`` else ``reason`` from a JSON object, else the whole reply."""
    blk = json_block(raw)
    fields = F.from_json(blk, "mismatch_explanation string, reason string")
    from_json_ = strip_text(F.coalesce(F.nullif(fields["mismatch_explanation"], F.lit("")),
                                       F.nullif(fields["reason"], F.lit("")), F.lit("")))
    return F.when(blk.isNotNull(), from_json_).otherwise(strip_text(raw))


def shown(text, limit: int) -> Column:
    """Text of a display view: at most ``limit`` characters, then '...'. Stored columns stay whole."""
    t = _c(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def normalize_bool(x, numeric: bool = False) -> Column:
    """Boolean label from text (EN + IT spellings, or an embedded true/false); NULL if invalid.

    ``numeric=True`` is for numeric columns: the value is rounded and tested against 0."""
    if numeric:
        v = _c(x).cast("double")
        return F.when(v.isNotNull() & ~F.isnan(v), F.bround(v) != 0)  # half-even, as Python round
    s = F.lower(strip_text(_c(x).cast("string")))
    return (F.when(s.isin(*TRUE_WORDS), F.lit(True))
            .when(s.isin(*FALSE_WORDS), F.lit(False))
            .when(s.rlike(r"(?U)\btrue\b"), F.lit(True))
            .when(s.rlike(r"(?U)\bfalse\b"), F.lit(False)))


def increment_score(x) -> Column:
    """First digit 1-5 anywhere in the text as INT; NULL if missing."""
    d = F.regexp_extract(_c(x).cast("string"), r"([1-5])", 1)
    return F.when(_c(x).isNotNull() & (d != ""), d.cast("int"))


def gold_from_increment(x) -> Column:
    """1 when the parsed increment is >= 4, 0 when lower, NULL when unparseable."""
    s = increment_score(x)
    return F.when(s.isNotNull(), (s >= 4).cast("int"))


def stable_hash(*parts, sep: str = "||") -> Column:
    """md5 hex of the parts joined by ``sep`` (fixed width: hex order = numeric order)."""
    return F.md5(F.concat_ws(sep, *[_c(p).cast("string") for p in parts]))


def hex_prefix_int(h, digits: int = 12) -> Column:
    """Integer value of the first ``digits`` hex digits (<= 15 digits fits BIGINT)."""
    return F.conv(F.substring(_c(h), 1, digits), 16, 10).cast("bigint")


def hash_coin(seed, row_id) -> Column:
    """Seeded fair coin: md5('{seed}:{id}') first 8 hex digits is even <=> 8th digit is even."""
    h = F.md5(F.concat_ws(":", _c(seed).cast("string"), _c(row_id).cast("string")))
    return F.substring(h, 8, 1).isin("0", "2", "4", "6", "8", "a", "c", "e")


def word_count(x) -> Column:
    """Whitespace word count (Python ``len(str.split())``); NULL text counts 0 words."""
    t = strip_text(x)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"(?U)\s+"))).cast("bigint")


def slugify(x) -> Column:
    s = F.regexp_replace(F.replace(F.lower(normalize_text(x)), F.lit("+"), F.lit("plus")),
                         r"[^a-z0-9]+", "_")
    s = F.regexp_replace(s, r"\A_+|_+\z", "")
    return F.when(s == "", F.lit("model")).otherwise(s)


def looks_incomplete(x) -> Column:
    """Shorter than 25 chars or ends with ':' or ','."""
    s = strip_text(x)
    return (F.length(s) < MIN_COMPLETE_CHARS) | s.endswith(":") | s.endswith(",")


# Single-word terms (" w ") are tested as tokens of the text split on single spaces; the others
# (" can vary ", " after surgery") by one substring test each.
_SINGLE_TERMS = [t.strip() for t in ENGLISH_TERMS if t.startswith(" ") and t.endswith(" ") and " " not in t.strip()]
_OTHER_TERMS = [t for t in ENGLISH_TERMS if t.strip() not in _SINGLE_TERMS]


def english_signal(x) -> Column:
    """Number of listed terms contained in ' ' + lower(text) + ' '.

    " w " occurs in the padded text exactly when "w" is one of its tokens between single spaces,
    so the single-word terms are one split plus a set intersection (one pass) instead of one
    substring scan per term."""
    padded = F.concat(F.lit(" "), F.lower(strip_text(x)), F.lit(" "))
    count = F.size(F.array_intersect(F.split(padded, " "), F.array(*[F.lit(w) for w in _SINGLE_TERMS])))
    for t in _OTHER_TERMS:
        count = count + F.when(F.instr(padded, F.lit(t)) > 0, F.lit(1)).otherwise(F.lit(0))
    return count.cast("bigint")


def shrunk_rewrite(original, rewrite) -> Column:
    n = F.length(strip_text(original))
    r = F.length(strip_text(rewrite))
    return (n >= SHRINK_MIN_ORIGINAL) & (r < F.greatest(F.lit(float(SHRINK_FLOOR)), n * SHRINK_RATIO))


def prompt_artifact(*texts) -> Column:
    """Role markers / template residue (same matches as ``PROMPT_ARTIFACT_RE`` on the stripped
    text). Literal parts are plain substring tests on the lower-cased text; the two regex parts
    run only on rows that contain '#' or start with a role word."""
    out = None
    for t in texts:
        low = F.lower(strip_text(t))
        c = ((F.instr(low, "answer with empathy") > 0) | (F.instr(low, "colonna answer") > 0)
             | F.when(F.instr(low, "#") > 0, low.rlike(r"(?U)#\s*(utente|assistente)")).otherwise(F.lit(False))
             | F.when(low.startswith("utente") | low.startswith("assistente"),
                      low.rlike(r"(?U)^(utente|assistente)\s*:")).otherwise(F.lit(False)))
        out = c if out is None else (out | c)
    return out


def broken_reasons(original, rewrite) -> Column:
    """';'-joined screening reasons in fixed order ('' when the row is clean)."""
    return F.concat_ws(
        ";",
        F.when(looks_incomplete(original), F.lit("original_incomplete")),
        F.when(looks_incomplete(rewrite), F.lit("empathy_incomplete")),
        F.when(shrunk_rewrite(original, rewrite), F.lit("empathy_much_shorter_than_original")),
        F.when(english_signal(original) >= ENGLISH_HEAVY_MIN_TERMS, F.lit("original_english_heavy")),
        F.when(english_signal(rewrite) >= ENGLISH_HEAVY_MIN_TERMS, F.lit("empathy_english_heavy")),
        F.when(prompt_artifact(original, rewrite), F.lit("prompt_artifact")),
    )


def broken_flag(original, rewrite) -> Column:
    """True when any screening rule fires (same rules as :func:`broken_reasons`), ordered cheapest
    first so the short-circuit OR skips the tokenising English test for most broken rows."""
    return (looks_incomplete(original) | looks_incomplete(rewrite) | shrunk_rewrite(original, rewrite)
            | prompt_artifact(original, rewrite)
            | (english_signal(original) >= ENGLISH_HEAVY_MIN_TERMS)
            | (english_signal(rewrite) >= ENGLISH_HEAVY_MIN_TERMS))


def classify_error(status, message, err_type) -> Column:
    """Readable failure text of a model call: class (auth/quota/rate/server/other) + message."""
    st = _c(status)
    low = F.lower(F.coalesce(_c(message), F.lit("")))

    def any_in(words):
        out = None
        for w in words:
            c = F.instr(low, w) > 0
            out = c if out is None else (out | c)
        return out

    reason = (F.when(st.isin(401, 403) | any_in(AUTH_WORDS), F.lit("Authentication/API key error"))
              .when((st == 402) | any_in(QUOTA_WORDS), F.lit("Quota/balance exhausted"))
              .when((st == 429) | any_in(RATE_WORDS), F.lit("Rate limit"))
              .when(st >= 500, F.lit("Provider/server error"))
              .otherwise(F.lit("API call failed")))
    whole = strip_text(F.replace(F.coalesce(_c(message), F.lit("")), F.lit("\n"), F.lit(" ")))
    http = F.when(st.isNotNull() & (st != 0), F.concat(F.lit(", HTTP "), st.cast("string"))).otherwise(F.lit(""))
    return F.concat(reason, F.lit(" ("), F.coalesce(_c(err_type), F.lit("Exception")), http,
                    F.lit("): "), whole)


def error_class(status, message) -> Column:
    """Only the class part of :func:`classify_error` (for grouping failures)."""
    return F.regexp_extract(classify_error(status, message, F.lit("E")), r"^(.*?) \(", 1)
