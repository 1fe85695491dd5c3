"""Readers for the shared parquet tables and the look-alike evaluation inputs derived from them.

Each ``fx_*`` builder returns a lazy DataFrame whose size grows with the given tables; Catalyst
prunes the columns each caller needs down to the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairjudge.functions.text import stable_hash

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _first_hex(col, pos: int = 1):
    return F.substring(F.md5(col), pos, 1)


def fx_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer-editing items: question (user turn), original answer (next assistant turn) and an
    edited answer ('' = not generated yet)."""
    conv = table(spark, sf_dir, "conversations")
    # An equi-join on the unique (conv_id, turn) key rather than lead() over a conversation window:
    # a very long conversation can never pile up in one task.
    u = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("original_answer"))
    p = u.join(a, ["conv_id", "turn"])
    h = _first_hex(F.col("original_answer"))
    gen = (F.when(h == "0", F.lit(""))
           .when(h < "9", F.concat(F.lit("I understand your concern. "), F.col("original_answer")))
           .otherwise(F.concat(F.lit("I understand your concern. "), F.col("original_answer"),
                               F.lit(" Please take good care of yourself."))))
    return p.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("item_id"),
        F.concat(F.lit("cat"), _first_hex(F.col("conv_id").cast("string"))).alias("category"),
        "question", "original_answer", gen.alias("generated_answer"))


JUDGES = ["j1", "j2"]
DIMENSIONS = ["empathy", "quality", "preservation", "unsupported_addition"]
PREFERENCE_DIMS = ["empathy", "quality"]
FACTUAL_DIMS = ["preservation", "unsupported_addition"]


def fx_verdicts(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None) -> DataFrame:
    """Long judge output: one raw reply per (item, judge, dimension), incl. blank / NULL /
    unparseable replies. The (judge x dimension) expansion is an ``explode`` of a literal array,
    not a join."""
    p = pairs if pairs is not None else fx_pairs(spark, sf_dir)
    combos = F.array(*[F.struct(F.lit(j).alias("judge"), F.lit(d).alias("dimension"))
                       for j in JUDGES for d in DIMENSIONS])
    x = p.select("item_id", "category", F.explode(combos).alias("jd")).select(
        "item_id", "category", "jd.judge", "jd.dimension")
    h = stable_hash("judge", "dimension", "item_id")
    h1, h2 = F.substring(h, 1, 1), F.substring(h, 2, 1)
    pref = (F.when(h1 == "9", F.lit("A.")).when(h1 == "a", F.lit("Answer: B"))
            .when(h1 == "b", F.lit("**A**")).when(h1 == "c", F.lit("b"))
            .when(h1 == "d", F.lit("cannot decide")).when(h1 == "e", F.lit(""))
            .when(h1 == "f", F.lit(None).cast("string"))
            .otherwise(F.when(h2 < "9", F.lit("A")).otherwise(F.lit("B"))))
    fact = (F.when(h1 == "a", F.lit("Yes.")).when(h1 == "b", F.lit("no, it does not"))
            .when(h1 == "c", F.lit("Answer: YES")).when(h1 == "d", F.lit("unclear"))
            .when(h1 == "e", F.lit("")).when(h1 == "f", F.lit(None).cast("string"))
            .otherwise(F.when(F.col("dimension") == "preservation", F.lit("Yes")).otherwise(F.lit("No"))))
    raw = F.when(F.col("dimension").isin(*PREFERENCE_DIMS), pref).otherwise(fact)
    return x.select("item_id", "category", "judge", "dimension", raw.alias("raw_response"))


def fx_rephrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rephrasing items (normal answer, empathy answer, free-text increment) with planted defects."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    key = F.md5(F.col("doc_id").cast("string"))
    k1, k2 = F.substring(key, 1, 1), F.substring(key, 2, 1)
    t = F.col("text")
    emp = (F.when(k1 == "0", F.substring(t, 1, 20)).when(k1 == "1", F.concat(t, F.lit(" come:")))
           .when(k1 == "2", F.concat(F.lit("# Utente "), t)).when(k1 == "3", F.substring(t, 1, 70))
           .when(k1 == "4", F.concat(t, F.lit(" the breast cancer symptoms and the stage with surgery or without answer ")))
           .otherwise(F.concat(F.lit("I see. "), t)))
    inc = (F.when(k2 == "0", F.lit("1")).when(k2 == "1", F.lit("2")).when(k2 == "2", F.lit("3 - medio"))
           .when(k2 == "3", F.lit(None).cast("string")).when(k2 == "4", F.lit("boh"))
           .when(k2 == "5", F.lit("5/5")).otherwise(F.lit("4 (alto)")))
    return d.select(F.col("doc_id").cast("string").alias("item_id"), "lang",
                    t.alias("normal_answer"), emp.alias("empathy_answer"), inc.alias("increment_raw"))


RATING_SOURCES = ["Physician", "ChatGPT"]
RATING_DIMS = ["Empathy", "Quality"]
EVALUATORS = [1, 2, 3]


def fx_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long ratings: (item, source, dimension, evaluator, score_raw), some non-numeric."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    combos = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(dm).alias("dimension"),
                                F.lit(e).alias("evaluator"))
                       for s in RATING_SOURCES for dm in RATING_DIMS for e in EVALUATORS])
    x = d.select("doc_id", F.explode(combos).alias("c")).select(
        "doc_id", "c.source", "c.dimension", "c.evaluator")
    h = stable_hash("doc_id", "source", "dimension", "evaluator")
    score = F.when(F.substring(h, 2, 1) == "0", F.lit("n/a")).otherwise(
        ((F.instr(F.lit("0123456789abcdef"), F.substring(h, 1, 1)) - 1) % 5 + 1).cast("string"))
    return x.select(F.col("doc_id").cast("string").alias("item_id"), "source", "dimension",
                    "evaluator", score.alias("score_raw"))


def fx_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two binary raters on the same items, with a category (labels joined to documents)."""
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    j = lab.join(docs, "doc_id")
    flip = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "3"
    return j.select(F.col("doc_id").cast("string").alias("item_id"), F.col("lang").alias("category"),
                    F.col("quality").alias("preserved"), F.col("toxic").alias("unsupported"),
                    F.col("quality").alias("rater_a"),
                    F.when(flip, 1 - F.col("quality")).otherwise(F.col("quality")).alias("rater_b"))


def fx_raters_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bench-size raters: one row per lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("_", *[F.col(c).cast("string") for c in
                           ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("item_id"),
        F.col("l_linestatus").alias("category"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("rater_a"),
        F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("rater_b"),
        F.col("l_quantity").alias("x"))


def fx_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated stored result rows (for keep-last, upsert, pending)."""
    ev = table(spark, sf_dir, "events")
    m = F.col("event_id") % 3
    pv = F.when(m == 0, F.lit("")).when(m == 1, F.lit("paper_minimal")).otherwise(F.lit("guided"))
    return ev.select(F.col("user_id").cast("string").alias("item_id"),
                     F.col("event_type").alias("judge_model"), pv.alias("prompt_variant"),
                     F.col("ts").alias("scored_at"), F.col("event_id").alias("seq"), "value")
