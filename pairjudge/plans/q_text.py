"""Registered queries: verdict parsing, reply JSON, labels, hashing, names, lengths, errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairjudge.functions import text as T
from pairjudge.plans.common import choice_sql, norm, wc, yes_no_sql
from pairjudge.plans.oracle_fx import with_fx
from pairjudge.plans.registry import register
from pairjudge.sources import tables as S

PREF = "dimension IN ('empathy', 'quality')"


def strip_sql(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')"


# --- verdict parsing --------------------------------------------------------------------------
@register("normalize_text", with_fx(f"""
SELECT item_id, {norm("concat(' ', replace(original_answer, chr(10), chr(13) || chr(10)), ' ' || chr(13))")} AS text
FROM fx_pairs""", "fx_pairs"))
def normalize_text(spark, sf):
    """CRLF/CR -> LF and strip, on answers planted with CRLF line ends and padding."""
    p = S.fx_pairs(spark, sf)
    planted = F.concat(F.lit(" "), F.replace("original_answer", F.lit("\n"), F.lit("\r\n")), F.lit(" \r"))
    return p.select("item_id", T.normalize_text(planted).alias("text"))


@register("parse_choice", with_fx(f"""
SELECT item_id, judge, dimension, {choice_sql('raw_response')} AS verdict
FROM fx_verdicts WHERE {PREF}""", "fx_verdicts"))
def parse_choice(spark, sf):
    v = S.fx_verdicts(spark, sf).where(F.col("dimension").isin("empathy", "quality"))
    return v.select("item_id", "judge", "dimension", T.parse_choice("raw_response").alias("verdict"))


@register("parse_yes_no", with_fx(f"""
SELECT item_id, judge, dimension, {yes_no_sql('raw_response')} AS verdict
FROM fx_verdicts WHERE NOT ({PREF})""", "fx_verdicts"))
def parse_yes_no(spark, sf):
    v = S.fx_verdicts(spark, sf).where(~F.col("dimension").isin("empathy", "quality"))
    return v.select("item_id", "judge", "dimension", T.parse_yes_no("raw_response").alias("verdict"))


@register("recover_choices", with_fx(f"""
SELECT item_id, judge, dimension,
  CASE WHEN stored IN ('A', 'B') THEN stored ELSE {choice_sql('raw_response')} END AS verdict
FROM (SELECT *, CASE WHEN raw_response IN ('A', 'B') THEN raw_response ELSE '' END AS stored
      FROM fx_verdicts WHERE {PREF})""", "fx_verdicts"))
def recover_choices(spark, sf):
    """Stored choice kept when it is A/B (older files stored only exact letters), else re-parsed."""
    v = S.fx_verdicts(spark, sf).where(F.col("dimension").isin("empathy", "quality"))
    stored = F.when(F.col("raw_response").isin("A", "B"), F.col("raw_response")).otherwise(F.lit(""))
    return v.select("item_id", "judge", "dimension", T.recover_choice(stored, F.col("raw_response")).alias("verdict"))


# --- reply JSON -------------------------------------------------------------------------------
def _replies(spark, sf):
    v = S.fx_verdicts(spark, sf)
    k = F.substring(F.md5(F.concat_ws("|", "item_id", "judge", "dimension")), 3, 1)
    raw = F.coalesce(F.col("raw_response"), F.lit(""))
    reply = (F.when(k < "4", F.concat(F.lit('{"choice": "'), raw, F.lit('", "reason": "r-'), F.col("item_id"), F.lit('"}')))
             .when(k < "8", F.concat(F.lit('Sure! {"mismatch_explanation": " because '), raw, F.lit(' "} thanks')))
             .when(k < "c", F.col("raw_response"))
             .otherwise(F.lit('{"other": 1}')))
    return v.select("item_id", "judge", "dimension", reply.alias("reply"))


REPLIES_SQL = """
SELECT item_id, judge, dimension,
  CASE WHEN k < '4' THEN concat('{"choice": "', coalesce(raw_response, ''), '", "reason": "r-', item_id, '"}')
       WHEN k < '8' THEN concat('Sure! {"mismatch_explanation": " because ', coalesce(raw_response, ''), ' "} thanks')
       WHEN k < 'c' THEN raw_response ELSE '{"other": 1}' END AS reply
FROM (SELECT *, substr(md5(concat_ws('|', item_id, judge, dimension)), 3, 1) AS k FROM fx_verdicts)"""

BLOCK_SQL = """(CASE WHEN t <> '' AND json_valid(t) AND starts_with(t, '{') THEN t
  WHEN regexp_extract(t, '(?s)\\{.*\\}', 0) <> '' AND json_valid(regexp_extract(t, '(?s)\\{.*\\}', 0))
  THEN regexp_extract(t, '(?s)\\{.*\\}', 0) END)"""


@register("parse_json_reply", with_fx(f"""
SELECT item_id, judge, dimension, json_extract_string(blk, '$.choice') AS choice, blk IS NOT NULL AS parsed
FROM (SELECT *, {BLOCK_SQL} AS blk FROM (SELECT *, {strip_sql('reply')} AS t FROM replies))""",
      "fx_verdicts", extra=[("replies", REPLIES_SQL)]))
def parse_json_reply(spark, sf):
    """JSON reply (whole text, else its outermost {...} block) -> the 'choice' field."""
    r = _replies(spark, sf)
    return r.select("item_id", "judge", "dimension", T.json_field("reply", "choice").alias("choice"),
                    T.json_block("reply").isNotNull().alias("parsed"))


@register("mismatch_explanation", with_fx(f"""
SELECT item_id, judge, dimension,
  CASE WHEN blk IS NOT NULL THEN {strip_sql("coalesce(nullif(json_extract_string(blk, '$.mismatch_explanation'), ''), nullif(json_extract_string(blk, '$.reason'), ''), '')")}
       ELSE t END AS explanation
FROM (SELECT *, {BLOCK_SQL} AS blk FROM (SELECT *, {strip_sql('reply')} AS t FROM replies))""",
      "fx_verdicts", extra=[("replies", REPLIES_SQL)]))
def mismatch_explanation(spark, sf):
    r = _replies(spark, sf)
    return r.select("item_id", "judge", "dimension", T.mismatch_explanation("reply").alias("explanation"))


# --- labels -----------------------------------------------------------------------------------
# Planted boolean label spellings, indexed by a hex digit of the item hash.
BOOL_SAMPLES = ["true", "Sì", "no", "nessun aumento", "1", "0", "The answer is TRUE", "false.",
                "maybe", "Increased", " yes ", "not increased", "aumento", "FALSE", "si", "x"]


def _bool_raw():
    arr = F.array(*[F.lit(x) for x in BOOL_SAMPLES])
    k = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.col("item_id")), 3, 1))
    return F.element_at(arr, k)


_BOOL_LIST = "[" + ", ".join("'" + x + "'" for x in BOOL_SAMPLES) + "]"


@register("normalize_bool", with_fx(f"""
SELECT item_id, label_raw,
  CASE WHEN s IN ('true', '1', 'yes', 'sì', 'si', 'aumento', 'increase', 'increased') THEN true
       WHEN s IN ('false', '0', 'no', 'nessun aumento', 'not increased', 'non aumento') THEN false
       WHEN regexp_matches(s, '\\btrue\\b') THEN true
       WHEN regexp_matches(s, '\\bfalse\\b') THEN false END AS value
FROM (SELECT item_id, label_raw, lower({strip_sql('label_raw')}) AS s
      FROM (SELECT item_id, {_BOOL_LIST}[instr('0123456789abcdef', substr(md5(item_id), 3, 1))] AS label_raw
            FROM fx_rephrase))""", "fx_rephrase"))
def normalize_bool(spark, sf):
    r = S.fx_rephrase(spark, sf).select("item_id").withColumn("label_raw", _bool_raw())
    return r.select("item_id", "label_raw", T.normalize_bool("label_raw").alias("value"))


@register("parse_gold_increment", with_fx("""
SELECT item_id, CAST(nullif(regexp_extract(increment_raw, '([1-5])', 1), '') AS INTEGER) AS score,
  CAST(CAST(nullif(regexp_extract(increment_raw, '([1-5])', 1), '') AS INTEGER) >= 4 AS INTEGER) AS gold
FROM fx_rephrase""", "fx_rephrase"))
def parse_gold_increment(spark, sf):
    r = S.fx_rephrase(spark, sf)
    return r.select("item_id", T.increment_score("increment_raw").alias("score"),
                    T.gold_from_increment("increment_raw").alias("gold"))


# --- hashing ----------------------------------------------------------------------------------
@register("stable_hash", with_fx("""
SELECT item_id, md5(concat_ws('||', '42', item_id)) AS hash_hex,
  CAST(('0x' || substr(md5(concat('42:', item_id)), 1, 12)) AS BIGINT) AS key48
FROM fx_pairs""", "fx_pairs"))
def stable_hash(spark, sf):
    p = S.fx_pairs(spark, sf)
    return p.select("item_id", T.stable_hash(F.lit(42), "item_id").alias("hash_hex"),
                    T.hex_prefix_int(F.md5(F.concat(F.lit("42:"), F.col("item_id"))), 12).alias("key48"))


@register("hash_coin", with_fx("""
SELECT item_id, CAST(('0x' || substr(md5(concat('42:', item_id)), 1, 8)) AS BIGINT) % 2 = 0 AS coin
FROM fx_pairs""", "fx_pairs"))
def hash_coin(spark, sf):
    p = S.fx_pairs(spark, sf)
    return p.select("item_id", T.hash_coin(F.lit(42), F.col("item_id")).alias("coin"))


def _labels(spark, sf):
    """Model labels built from the events table (one per event)."""
    ev = S.table(spark, sf, "events").select("event_id", "event_type")
    h = F.md5(F.col("event_id").cast("string"))
    label = F.concat(F.when(F.substring(h, 1, 1) < "8", F.lit("+ ")).otherwise(F.lit("")),
                     F.upper(F.col("event_type")), F.lit(" "), F.substring(h, 2, 3), F.lit("/V3 Ultra+"))
    label = F.when(F.substring(h, 5, 1) == "0", F.lit("+ llama-3.3-70b-versatile")) \
             .when(F.substring(h, 5, 1) == "1", F.lit(" +++ ")).otherwise(label)
    return ev.select("event_id", label.alias("label"), F.substring(h, 6, 1).alias("k"))


LABELS_SQL = """
SELECT event_id,
  CASE WHEN substr(h, 5, 1) = '0' THEN '+ llama-3.3-70b-versatile'
       WHEN substr(h, 5, 1) = '1' THEN ' +++ '
       ELSE concat(CASE WHEN substr(h, 1, 1) < '8' THEN '+ ' ELSE '' END, upper(event_type), ' ',
                   substr(h, 2, 3), '/V3 Ultra+') END AS label, substr(h, 6, 1) AS k
FROM (SELECT event_id, event_type, md5(CAST(event_id AS VARCHAR)) AS h FROM events)"""


def slug_sql(x: str) -> str:
    s = f"regexp_replace(regexp_replace(replace(lower({norm(x)}), '+', 'plus'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"(CASE WHEN {s} = '' THEN 'model' ELSE {s} END)"


@register("slugify", f"WITH labels AS ({LABELS_SQL})\nSELECT event_id, label, {slug_sql('label')} AS slug FROM labels")
def slugify(spark, sf):
    lab = _labels(spark, sf)
    return lab.select("event_id", "label", T.slugify("label").alias("slug"))


# Run-name format. One generator label keeps a short legacy name in file names.
LLAMA_LABEL = "+ llama-3.3-70b-versatile"
RUN_PREFIX = "current_run_IMB"


def run_key_cols(subset, variant, gen, judge, seed):
    """Run names for a generation file and a judge file (subset 'normal' and variant 'v1' add no
    suffix; one generator keeps its short legacy name)."""
    sub = T.normalize_text(subset)
    sub = F.when(sub == "", F.lit("normal")).otherwise(sub)
    suffix = F.when(sub == "normal", F.lit("")).otherwise(F.concat(F.lit("_"), F.upper(sub)))
    v = T.normalize_text(variant)
    v = F.when(v == "", F.lit("v1")).otherwise(v)
    pv = F.when(v == "v1", F.lit("")).otherwise(F.concat(F.lit("_"), F.upper(v)))
    is_llama = gen == LLAMA_LABEL
    gen_part = F.when(is_llama, F.lit("LLAMA")).otherwise(T.slugify(gen))
    gen_slug = F.when(is_llama, F.lit("llama")).otherwise(T.slugify(gen))
    s = seed.cast("string")
    gen_key = F.concat(F.lit(RUN_PREFIX), suffix, pv, F.lit("_GENERATED_BY_"), gen_part,
                       F.lit("_seed-"), s, F.lit(".csv"))
    judge_key = F.concat(F.lit(RUN_PREFIX), suffix, pv, F.lit("_GENERATED_BY_"), gen_slug,
                         F.lit("_JUDGED_BY_"), T.slugify(judge), F.lit("_seed-"), s, F.lit(".csv"))
    return gen_key, judge_key


def _runs(spark, sf):
    lab = _labels(spark, sf)
    k = F.col("k")
    subset = F.when(k < "5", F.lit("normal")).when(k < "a", F.lit("short")).otherwise(F.lit(""))
    variant = F.when(k < "3", F.lit("v1")).when(k < "6", F.lit("v3_refined_clinical_editing")) \
               .when(k < "9", F.lit("v4_concise_clinical_editing")).when(k < "c", F.lit("v2_length_matched")) \
               .otherwise(F.lit(" "))
    judge = F.when(k < "8", F.lit("+ openai/gpt-oss-120b")).otherwise(F.lit(LLAMA_LABEL))
    return lab.select("event_id", subset.alias("subset"), variant.alias("variant"),
                      F.col("label").alias("generator"), judge.alias("judge"),
                      (F.col("event_id") % 100).alias("seed"))


RUNS_SQL = """
SELECT event_id,
  CASE WHEN k < '5' THEN 'normal' WHEN k < 'a' THEN 'short' ELSE '' END AS subset,
  CASE WHEN k < '3' THEN 'v1' WHEN k < '6' THEN 'v3_refined_clinical_editing'
       WHEN k < '9' THEN 'v4_concise_clinical_editing' WHEN k < 'c' THEN 'v2_length_matched' ELSE ' ' END AS variant,
  label AS generator,
  CASE WHEN k < '8' THEN '+ openai/gpt-oss-120b' ELSE '+ llama-3.3-70b-versatile' END AS judge,
  event_id % 100 AS seed
FROM labels"""


def _run_key_sql() -> tuple[str, str]:
    sub = f"(CASE WHEN {norm('subset')} = '' THEN 'normal' ELSE {norm('subset')} END)"
    suffix = f"(CASE WHEN {sub} = 'normal' THEN '' ELSE '_' || upper({sub}) END)"
    v = f"(CASE WHEN {norm('variant')} = '' THEN 'v1' ELSE {norm('variant')} END)"
    pv = f"(CASE WHEN {v} = 'v1' THEN '' ELSE '_' || upper({v}) END)"
    gp = f"(CASE WHEN generator = '{LLAMA_LABEL}' THEN 'LLAMA' ELSE {slug_sql('generator')} END)"
    gs = f"(CASE WHEN generator = '{LLAMA_LABEL}' THEN 'llama' ELSE {slug_sql('generator')} END)"
    gk = f"concat('current_run_IMB', {suffix}, {pv}, '_GENERATED_BY_', {gp}, '_seed-', CAST(seed AS VARCHAR), '.csv')"
    jk = (f"concat('current_run_IMB', {suffix}, {pv}, '_GENERATED_BY_', {gs}, '_JUDGED_BY_', {slug_sql('judge')},"
          f" '_seed-', CAST(seed AS VARCHAR), '.csv')")
    return gk, jk


_GK, _JK = _run_key_sql()


@register("run_key", f"WITH labels AS ({LABELS_SQL}), runs AS ({RUNS_SQL})\n"
                     f"SELECT event_id, {_GK} AS gen_key, {_JK} AS judge_key FROM runs")
def run_key(spark, sf):
    r = _runs(spark, sf)
    gk, jk = run_key_cols(F.col("subset"), F.col("variant"), F.col("generator"), F.col("judge"), F.col("seed"))
    return r.select("event_id", gk.alias("gen_key"), jk.alias("judge_key"))


# Variant names recognised in file names, by precedence.
VARIANT_TOKENS = [("V4_CONCISE_CLINICAL_EDITING", "v4_concise_clinical_editing"),
                  ("V3_REFINED_CLINICAL_EDITING", "v3_refined_clinical_editing"),
                  ("V2_LENGTH_MATCHED", "v2_length_matched")]


def infer_variant(path):
    name = F.upper(F.replace(F.regexp_extract(path, r"([^/]*)$", 1), F.lit(" "), F.lit("_")))
    out = None
    for token, v in VARIANT_TOKENS:
        cond = F.instr(name, token) > 0
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out.otherwise(F.lit("v1"))


def _infer_sql(path: str) -> str:
    name = f"upper(replace(regexp_extract({path}, '([^/]*)$', 1), ' ', '_'))"
    parts = " ".join(f"WHEN instr({name}, '{t}') > 0 THEN '{v}'" for t, v in VARIANT_TOKENS)
    return f"(CASE {parts} ELSE 'v1' END)"


def _files(spark, sf):
    """A stored file name per judged row of the results fixture (folder + run name)."""
    r = S.fx_results(spark, sf)
    h = F.md5(F.col("seq").cast("string"))
    k = F.substring(h, 1, 1)
    name = (F.when(k < "4", F.lit("V4 CONCISE CLINICAL EDITING")).when(k < "8", F.lit("V3_REFINED_CLINICAL_EDITING"))
            .when(k < "c", F.lit("v2 length matched")).otherwise(F.lit("plain")))
    folder = F.when(F.substring(h, 3, 1) < "8", F.lit("V2_LENGTH_MATCHED/")).otherwise(F.lit("runs/"))
    path = F.concat(folder, F.lit("current_run IMB "), name, F.lit("_seed-42.csv"))
    k2 = F.substring(h, 2, 1)
    variant = F.when(k2 == "0", F.lit("None")).when(k2 == "1", F.lit("v1")).when(k2 == "2", F.lit(None).cast("string")) \
               .when(k2 == "3", F.lit(" NaN ")).otherwise(F.col("prompt_variant"))
    return r.select("seq", path.alias("path"), variant.alias("variant"))


FILES_SQL = """
SELECT seq,
  concat(CASE WHEN substr(h, 3, 1) < '8' THEN 'V2_LENGTH_MATCHED/' ELSE 'runs/' END, 'current_run IMB ',
    CASE WHEN substr(h, 1, 1) < '4' THEN 'V4 CONCISE CLINICAL EDITING' WHEN substr(h, 1, 1) < '8' THEN 'V3_REFINED_CLINICAL_EDITING'
         WHEN substr(h, 1, 1) < 'c' THEN 'v2 length matched' ELSE 'plain' END, '_seed-42.csv') AS path,
  CASE substr(h, 2, 1) WHEN '0' THEN 'None' WHEN '1' THEN 'v1' WHEN '2' THEN NULL WHEN '3' THEN ' NaN '
       ELSE prompt_variant END AS variant
FROM (SELECT *, md5(CAST(seq AS VARCHAR)) AS h FROM fx_results)"""


@register("infer_variant_from_name", with_fx(f"SELECT seq, {_infer_sql('path')} AS inferred FROM files",
                                             "fx_results", extra=[("files", FILES_SQL)]))
def infer_variant_from_name(spark, sf):
    f = _files(spark, sf)
    return f.select("seq", infer_variant(F.col("path")).alias("inferred"))


def backfill_variant_col(variant, inferred):
    """blank / nan / none -> 'v1'; when the file name names V2-V4, rows still at 'v1' take it
    (others keep their stored value)."""
    v = T.normalize_text(variant)
    normalized = F.when((v == "") | F.lower(v).isin("nan", "none"), F.lit("v1")).otherwise(v)
    return F.when(inferred == "v1", normalized).when(normalized == "v1", inferred).otherwise(variant)


@register("backfill_variant", with_fx(f"""
SELECT seq, CASE WHEN inferred = 'v1' THEN nv WHEN nv = 'v1' THEN inferred ELSE variant END AS variant
FROM (SELECT seq, variant, {_infer_sql('path')} AS inferred,
        CASE WHEN {norm('variant')} = '' OR lower({norm('variant')}) IN ('nan', 'none') THEN 'v1' ELSE {norm('variant')} END AS nv
      FROM files)""", "fx_results", extra=[("files", FILES_SQL)]))
def backfill_variant(spark, sf):
    f = _files(spark, sf)
    return f.select("seq", backfill_variant_col(F.col("variant"), infer_variant(F.col("path"))).alias("variant"))


# --- lengths ----------------------------------------------------------------------------------
@register("word_count", with_fx(f"""
SELECT item_id, {wc('original_answer')} AS orig_wc, {wc('generated_answer')} AS gen_wc FROM fx_pairs""", "fx_pairs"))
def word_count(spark, sf):
    p = S.fx_pairs(spark, sf)
    return p.select("item_id", T.word_count("original_answer").alias("orig_wc"),
                    T.word_count("generated_answer").alias("gen_wc"))


@register("length_delta_ratio", with_fx(f"""
SELECT item_id, gen_wc - orig_wc AS delta, CASE WHEN orig_wc = 0 THEN NULL ELSE CAST(gen_wc AS DOUBLE) / orig_wc END AS ratio
FROM (SELECT item_id, {wc('original_answer')} AS orig_wc, {wc('generated_answer')} AS gen_wc FROM fx_pairs)""", "fx_pairs"))
def length_delta_ratio(spark, sf):
    p = S.fx_pairs(spark, sf)
    g, o = T.word_count("generated_answer"), T.word_count("original_answer")
    return p.select("item_id", (g - o).alias("delta"), F.try_divide(g.cast("double"), o).alias("ratio"))


# --- model-call failures ----------------------------------------------------------------------
def _failures(spark, sf):
    ev = S.table(spark, sf, "events").select("event_id", "ts")
    h = F.md5(F.concat(F.lit("err:"), F.col("event_id").cast("string")))
    k = F.substring(h, 1, 1)
    status = (F.when(k == "0", F.lit(401)).when(k == "1", F.lit(402)).when(k == "2", F.lit(429))
              .when(k == "3", F.lit(500)).when(k == "4", F.lit(503)).when(k == "5", F.lit(0))
              .otherwise(F.lit(None).cast("int")))
    k2 = F.substring(h, 2, 1)
    msg = (F.when(k2 < "3", F.lit("Invalid API key provided"))
           .when(k2 < "6", F.lit("You exceeded your current quota, check billing"))
           .when(k2 < "9", F.lit("Rate limit reached. Too Many Requests"))
           .when(k2 < "c", F.lit("upstream connect error\nreset before headers"))
           .otherwise(F.concat(F.lit("x"), F.repeat(F.lit("long failure text "), 60))))
    etype = F.when(F.substring(h, 3, 1) < "8", F.lit("APIStatusError")).otherwise(F.lit("RateLimitError"))
    return ev.select("event_id", "ts", status.alias("status"),
                     F.concat(msg, F.lit(" #"), F.col("event_id").cast("string")).alias("message"),
                     etype.alias("err_type"))


FAILURES_SQL = """
SELECT event_id, ts,
  CASE substr(h, 1, 1) WHEN '0' THEN 401 WHEN '1' THEN 402 WHEN '2' THEN 429 WHEN '3' THEN 500
       WHEN '4' THEN 503 WHEN '5' THEN 0 END AS status,
  concat(CASE WHEN substr(h, 2, 1) < '3' THEN 'Invalid API key provided'
              WHEN substr(h, 2, 1) < '6' THEN 'You exceeded your current quota, check billing'
              WHEN substr(h, 2, 1) < '9' THEN 'Rate limit reached. Too Many Requests'
              WHEN substr(h, 2, 1) < 'c' THEN 'upstream connect error' || chr(10) || 'reset before headers'
              ELSE 'x' || repeat('long failure text ', 60) END, ' #', CAST(event_id AS VARCHAR)) AS message,
  CASE WHEN substr(h, 3, 1) < '8' THEN 'APIStatusError' ELSE 'RateLimitError' END AS err_type
FROM (SELECT event_id, ts, md5(concat('err:', CAST(event_id AS VARCHAR))) AS h FROM events)"""


def _error_sql() -> tuple[str, str]:
    low = "lower(coalesce(message, ''))"

    def any_in(words):
        return " OR ".join(f"instr({low}, '{w}') > 0" for w in words)

    reason = (f"(CASE WHEN status IN (401, 403) OR {any_in(T.AUTH_WORDS)} THEN 'Authentication/API key error' "
              f"WHEN status = 402 OR {any_in(T.QUOTA_WORDS)} THEN 'Quota/balance exhausted' "
              f"WHEN status = 429 OR {any_in(T.RATE_WORDS)} THEN 'Rate limit' "
              f"WHEN status >= 500 THEN 'Provider/server error' ELSE 'API call failed' END)")
    shown = strip_sql("replace(coalesce(message, ''), chr(10), ' ')")
    http = "(CASE WHEN status IS NOT NULL AND status <> 0 THEN ', HTTP ' || CAST(status AS VARCHAR) ELSE '' END)"
    return reason, f"concat({reason}, ' (', coalesce(err_type, 'Exception'), {http}, '): ', {shown})"


_REASON, _ERRTEXT = _error_sql()


@register("classify_error", f"WITH failures AS ({FAILURES_SQL})\nSELECT event_id, {_ERRTEXT} AS error_text FROM failures")
def classify_error(spark, sf):
    f = _failures(spark, sf)
    return f.select("event_id", T.classify_error(F.col("status"), F.col("message"), F.col("err_type")).alias("error_text"))


@register("failure_report", f"""WITH failures AS ({FAILURES_SQL})
SELECT {_REASON} AS error_class, count(*) AS n, arg_max({_ERRTEXT}, event_id) AS last_error, max(event_id) AS last_event_id
FROM failures GROUP BY 1""")
def failure_report(spark, sf):
    """Failures grouped by class with the count and the most recent error."""
    f = _failures(spark, sf).withColumn(
        "error_text", T.classify_error(F.col("status"), F.col("message"), F.col("err_type")))
    return f.groupBy(T.error_class(F.col("status"), F.col("message")).alias("error_class")).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("error_text", "event_id").alias("last_error"),
        F.max("event_id").alias("last_event_id"))
