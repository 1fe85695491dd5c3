"""Case tables for the parsers and screening rules (incl. accents, CRLF, NBSP, NULL, empty)."""

import pytest
from pyspark.sql import functions as F

from pairjudge.functions import text as T


def _eval(spark, fn, values, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


CHOICE = [("A", "A"), ("B", "B"), ("a", "A"), ("b.", "B"), ("A.", "A"), ("B\nbecause", "B"),
          ("Answer: B", "B"), ("**A**", "A"), ("I think a better one is B", "A"), ("cannot decide", None),
          ("", None), (None, None), ("\r\n  B  \r\n", "B"), ("ÈA B", "B"), ("AB", None), (" A ", "A")]


def test_parse_choice(spark):
    got = _eval(spark, T.parse_choice, [c for c, _ in CHOICE])
    assert got == [w for _, w in CHOICE]


def test_parse_choice_strict(spark):
    got = _eval(spark, lambda c: T.parse_choice(c, strict=True), ["I think a better one is B", "a", "A"])
    assert got == ["B", None, "A"]


YESNO = [("Yes", "Yes"), ("yes.", "Yes"), ("No", "No"), ("no, it does not", "No"), ("Answer: YES", "Yes"),
         ("unclear", None), ("", None), (None, None), ("Nope", None), ("I'd say no\nyes", "No")]


def test_parse_yes_no(spark):
    assert _eval(spark, T.parse_yes_no, [c for c, _ in YESNO]) == [w for _, w in YESNO]


def test_normalize_text(spark):
    vals = [None, "  a\r\nb\rc  ", " x ", "\n\n"]
    assert _eval(spark, T.normalize_text, vals) == ["", "a\nb\nc", "x", ""]


BOOL = [("true", True), ("Sì", True), ("si", True), ("increased", True), ("1", True), ("no", False),
        ("nessun aumento", False), ("0", False), ("it is TRUE", True), ("false.", False), ("maybe", None),
        (None, None)]


def test_normalize_bool(spark):
    assert _eval(spark, T.normalize_bool, [c for c, _ in BOOL]) == [w for _, w in BOOL]


INC = [("4 (alto)", 4, 1), ("5/5", 5, 1), ("3 - medio", 3, 0), ("10", 1, 0), ("boh", None, None), (None, None, None)]


def test_gold_increment(spark):
    assert _eval(spark, T.increment_score, [c for c, _, _ in INC]) == [s for _, s, _ in INC]
    assert _eval(spark, T.gold_from_increment, [c for c, _, _ in INC]) == [g for _, _, g in INC]


def test_word_count(spark):
    vals = [None, "", "  ", "one", " two  words ", "tab\tand\nnew line", "nb sp"]
    assert _eval(spark, T.word_count, vals) == [0, 0, 0, 1, 2, 4, 2]


def test_slugify(spark):
    vals = ["+ llama-3.3-70b-versatile", "GPT-5.4 mini", " +++ ", "", None, "openai/gpt-oss-120b"]
    assert _eval(spark, T.slugify, vals) == ["plus_llama_3_3_70b_versatile", "gpt_5_4_mini", "plusplusplus",
                                              "model", "model", "openai_gpt_oss_120b"]


def test_stable_hash_and_coin(spark):
    import hashlib
    df = spark.createDataFrame([("x1",), ("abc",)], "id string")
    rows = df.select("id", T.stable_hash(F.lit(7), "id").alias("h"), T.hash_coin(F.lit(7), F.col("id")).alias("c"),
                     T.hex_prefix_int(F.md5(F.concat(F.lit("7:"), F.col("id"))), 12).alias("k")).collect()
    for r in rows:
        assert r["h"] == hashlib.md5(f"7||{r['id']}".encode()).hexdigest()
        d = hashlib.md5(f"7:{r['id']}".encode()).hexdigest()
        assert r["c"] == (int(d[:8], 16) % 2 == 0)
        assert r["k"] == int(d[:12], 16)


def test_screening_rules(spark):
    long = "parola " * 40
    rows = [("short", long), (long, long + " e poi:"), (long, long[:50]),
            (long, "# Utente " + long), (long, "the and with symptoms " + long), (long, long)]
    df = spark.createDataFrame(rows, "o string, r string")
    got = [r["x"] for r in df.select(T.broken_reasons("o", "r").alias("x")).collect()]
    assert got[0] == "original_incomplete"
    assert got[1] == "empathy_incomplete"
    assert got[2] == "empathy_much_shorter_than_original"
    assert got[3] == "prompt_artifact"
    assert got[4] == "empathy_english_heavy"
    assert got[5] == ""


def test_english_signal_counts_distinct_terms(spark):
    vals = ["The the THE", "with and\nwithout", "it can vary after surgery", "including include", ""]
    assert _eval(spark, T.english_signal, vals) == [1, 1, 3, 2, 0]  # " surgery " counts too


def test_prompt_artifact_anchor(spark):
    vals = ["utente: ciao", "  Assistente :x", "ciao utente: no", "#   assistente", "Answer With Empathy", "pulito"]
    got = _eval(spark, lambda c: T.prompt_artifact(c), vals)
    assert got == [True, True, False, True, True, False]


def test_classify_error(spark):
    df = spark.createDataFrame([(401, "bad", "AuthError"), (None, "You exceeded your quota", "E"),
                                (429, "slow down", "RateLimitError"), (503, "boom\nagain", "APIError"),
                                (0, "x" * 1000, "E")], "s int, m string, t string")
    got = [r["o"] for r in df.select(T.classify_error(F.col("s"), F.col("m"), F.col("t")).alias("o")).collect()]
    assert got[0] == "Authentication/API key error (AuthError, HTTP 401): bad"
    assert got[1] == "Quota/balance exhausted (E): You exceeded your quota"
    assert got[2] == "Rate limit (RateLimitError, HTTP 429): slow down"
    assert got[3] == "Provider/server error (APIError, HTTP 503): boom again"
    assert got[4].startswith("API call failed (E): ") and len(got[4]) == len("API call failed (E): ") + 1000


@pytest.mark.parametrize("raw,want", [('{"mismatch_explanation": " because "}', "because"),
                                      ('Sure {"reason": "r1"} ok', "r1"), ("plain text", "plain text"),
                                      ('{"other": 1}', ""), ("", ""), (None, "")])
def test_mismatch_explanation(spark, raw, want):
    assert _eval(spark, T.mismatch_explanation, [raw]) == [want]


def test_normalize_bool_numeric(spark):
    df = spark.createDataFrame([(0.4,), (0.6,), (2.0,), (None,), (float("nan"),), (0.5,), (1.5,)], "v double")
    got = [r["o"] for r in df.select(T.normalize_bool(F.col("v"), numeric=True).alias("o")).collect()]
    assert got == [False, True, True, None, None, False, True]


def test_render_single_pass_and_literal_braces(spark):
    from pairjudge.functions import prompts as P
    tpl = P.template("calibration_explain", "rephrase")[1]
    df = spark.createDataFrame([("{gold_choice} inside", "B")], "normal_answer string, gold_choice string")
    out = df.select(P.render(tpl, normal_answer=F.col("normal_answer"), gold_choice=F.col("gold_choice"),
                             question=F.lit("q"), empathy_answer=F.lit("e"), response_order=F.lit("o"),
                             pred_choice=F.lit("A")).alias("p")).first()["p"]
    assert "{gold_choice} inside" in out            # an answer is never re-expanded
    assert '{{"mismatch_explanation"' in out         # doubled braces reach the model as written
    assert "Correct choice according to the gold label:\nB" in out
