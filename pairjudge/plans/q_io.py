"""Registered queries: sources, schema contracts and sinks (each writes data derived from the given
tables to the shared scratch folder and reads it back through the operator under test)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairjudge.functions import text as TX
from pairjudge.plans.common import OUTCOME_CTES, outcomes
from pairjudge.plans.oracle_fx import with_fx
from pairjudge.plans.q_runs import IN_RUN, KEYS, LAST_SQL, NEWVIEW, RES_SQL, RUN_JUDGE, RUN_VARIANT, _new_view, stored
from pairjudge.plans.registry import register
from pairjudge.plans.common import wc
from pairjudge.sources import io as IO
from pairjudge.sources import tables as S

PAIRS_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in
                             ("item_id", "category", "question", "original_answer", "generated_answer")])


@register("read_table", with_fx("""
SELECT item_id, category, md5(coalesce(question, '')) AS q_md5, md5(coalesce(original_answer, '')) AS o_md5,
  md5(coalesce(generated_answer, '')) AS g_md5
FROM fx_pairs""", "fx_pairs"))
def read_table(spark, sf):
    """TSV round trip with multi-line quoted answers, read back with an explicit schema."""
    path = IO.scratch_path(spark, "pairs_tsv")
    IO.write_csv(S.fx_pairs(spark, sf), path, sep="\t")
    t = IO.read_table(spark, path, PAIRS_SCHEMA, sep="\t")
    return t.select("item_id", "category", F.md5("question").alias("q_md5"), F.md5("original_answer").alias("o_md5"),
                    F.md5("generated_answer").alias("g_md5"))


@register("export_csv", with_fx("SELECT item_id, judge, dimension, coalesce(raw_response, '') AS raw_response FROM fx_verdicts",
                                "fx_verdicts"))
def export_csv(spark, sf):
    """CSV export (header, '"' escaping) of the judge rows, read back; text NULL reads as ''."""
    path = IO.scratch_path(spark, "verdicts_csv")
    v = S.fx_verdicts(spark, sf).select("item_id", "judge", "dimension", "raw_response")
    IO.write_csv(v, path)
    return IO.read_table(spark, path, "item_id string, judge string, dimension string, raw_response string")


@register("read_salvage", with_fx(f"""
SELECT item_id, CASE WHEN substr(md5(item_id), 1, 1) IN ('0', '1') THEN 'quarantined' ELSE 'ok' END AS status,
  CAST(CASE WHEN substr(md5(item_id), 1, 1) IN ('0', '1') THEN NULL ELSE {wc('original_answer')} END AS INTEGER) AS n_words
FROM fx_pairs""", "fx_pairs"))
def read_salvage(spark, sf):
    """Lines with an unparseable count are quarantined; every other line is kept."""
    p = S.fx_pairs(spark, sf)
    bad = F.substring(F.md5("item_id"), 1, 1).isin("0", "1")
    n = F.when(bad, F.lit("many")).otherwise(TX.word_count("original_answer").cast("string"))
    path = IO.scratch_path(spark, "salvage")
    IO.write_csv(p.select("item_id", "category", n.alias("n_words")), path)
    good, quarantined = IO.read_salvage(spark, path, T.StructType([
        T.StructField("item_id", T.StringType()), T.StructField("category", T.StringType()),
        T.StructField("n_words", T.IntegerType())]))
    q = quarantined.select(F.coalesce("item_id", F.substring_index("_corrupt_record", ",", 1)).alias("item_id"),
                           F.lit("quarantined").alias("status"), F.lit(None).cast("int").alias("n_words"))
    return good.select("item_id", F.lit("ok").alias("status"), "n_words").unionByName(q)


DOC_SCHEMA = "doc_id long, lang string, text string"


@register("read_encoding_fallback", "SELECT doc_id, lang, md5(text) AS t_md5 FROM documents")
def read_encoding_fallback(spark, sf):
    """Documents written half as UTF-8 and half as Latin-1 files, read back with the per-file
    fallback decision."""
    d = S.table(spark, sf, "documents").select("doc_id", "lang", "text")
    path = IO.scratch_path(spark, "encodings")
    IO.write_csv(d.where(F.col("lang").isin("en", "de")), f"{path}/utf8")
    IO.write_csv(d.where(~F.col("lang").isin("en", "de")), f"{path}/latin1", encoding="ISO-8859-1")
    r = IO.read_encoding_fallback(spark, f"{path}/*", DOC_SCHEMA)
    return r.select("doc_id", "lang", F.md5("text").alias("t_md5"))


@register("require_columns", with_fx("SELECT item_id, category FROM fx_pairs", "fx_pairs"))
def require_columns(spark, sf):
    """The answer-editing item contract is checked before any job (raises naming what is missing)."""
    p = IO.require_columns(S.fx_pairs(spark, sf), ["item_id", "category", "question", "original_answer"])
    return p.select("item_id", "category")


@register("derive_item_id", """
SELECT 'postID' AS source, CAST(doc_id AS VARCHAR) AS item_id FROM documents
UNION ALL
SELECT 'content', sha256(concat_ws(chr(1), coalesce(url, chr(2)), coalesce(html, chr(2)))) FROM pages""")
def derive_item_id(spark, sf):
    """Id column precedence (id, postID, 'Unnamed: 0'); without any, a content hash."""
    d = S.table(spark, sf, "documents").select(F.col("doc_id").alias("postID"), "lang")
    a = IO.derive_item_id(d).select(F.lit("postID").alias("source"), "item_id")
    pg = S.table(spark, sf, "pages").select("url", "html")
    b = IO.derive_item_id(pg).select(F.lit("content").alias("source"), "item_id")
    return a.unionByName(b)


RESULT_CONTRACT = [("item_id", "string", None), ("judge", "string", ""), ("dimension", "string", ""),
                   ("raw_response", "string", ""), ("verdict", "string", ""), ("score", "double", None),
                   ("error", "string", "")]


@register("derive_item_id_by_row", "SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS item_id, doc_id, md5(text) AS t_md5 FROM documents")
def derive_item_id_by_row(spark, sf):
    """Documents in several CSV files in doc_id order, without an id column for the reader: the row's place in the files is its id."""
    path = IO.scratch_path(spark, "row-ids")
    d = S.table(spark, sf, "documents").select("doc_id", "text")
    IO.write_csv(d.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), path)
    r = IO.derive_item_id(IO.read_table(spark, path, "doc_id long, text string"), by_row_index=True)
    return r.select("item_id", "doc_id", F.md5("text").alias("t_md5"))


@register("conform_schema", with_fx("""
SELECT item_id, coalesce(judge, '') AS judge, coalesce(dimension, '') AS dimension,
  coalesce(raw_response, '') AS raw_response, '' AS verdict, CAST(NULL AS DOUBLE) AS score, '' AS error
FROM fx_verdicts""", "fx_verdicts"))
def conform_schema(spark, sf):
    """Judge rows conformed to the result contract (missing columns defaulted, extras dropped)."""
    return IO.conform(S.fx_verdicts(spark, sf), RESULT_CONTRACT)


@register("load_labelled_runs", with_fx("""
SELECT 'llama' AS generator, 'plus_' || judge AS judge, 42 AS seed, item_id, fp FROM ox_outcomes""",
                                        "fx_pairs", "fx_verdicts", extra=OUTCOME_CTES))
def load_labelled_runs(spark, sf):
    """One result file per (generator, judge, seed), all read at once and labelled from the names."""
    o = outcomes(spark, sf)
    run = F.concat(F.lit("current_run_IMB_V3_REFINED_CLINICAL_EDITING_GENERATED_BY_llama_JUDGED_BY_plus_"),
                   F.col("judge"), F.lit("_seed-42"))
    path = IO.scratch_path(spark, "runs")
    o.select(run.alias("run"), "item_id", "fp").write.mode("overwrite").partitionBy("run") \
        .option("header", True).csv(path)
    r = IO.load_labelled_runs(spark, path, "item_id string, fp int")
    return r.select("generator", "judge", "seed", "item_id", "fp")


@register("write_results", with_fx(f"""
SELECT item_id, judge_model, prompt_variant, seq, value FROM res WHERE NOT {IN_RUN}
UNION ALL SELECT * FROM newview""", "fx_results", extra=[RES_SQL, LAST_SQL, NEWVIEW]))
def write_results(spark, sf):
    """Partitioned store: all runs written, then one run's folder replaced by nothing, and that by a freshly scored view."""
    path = IO.scratch_path(spark, "store")
    st = stored(spark, sf).select(*KEYS, "seq", "value")
    IO.write_results(st, path, ["judge_model", "prompt_variant"])
    run, view = {"judge_model": RUN_JUDGE, "prompt_variant": RUN_VARIANT}, _new_view(spark, sf)
    IO.replace_run(view.limit(0), path, run)
    IO.replace_run(view, path, run)
    back = spark.read.parquet(path)
    return back.select(*KEYS, "seq", "value")


@register("export_report", with_fx("""
SELECT 'category_counts' AS section, category AS key, count(*) AS n FROM fx_pairs GROUP BY category
UNION ALL SELECT 'judge_counts', judge, count(*) FROM fx_verdicts GROUP BY judge""", "fx_pairs", "fx_verdicts"))
def export_report(spark, sf):
    """Report tables written as JSON lines, one folder per section, and read back."""
    path = IO.scratch_path(spark, "report")
    IO.export_report({"category_counts": S.fx_pairs(spark, sf).groupBy(F.col("category").alias("key")).agg(F.count(F.lit(1)).alias("n")),
                      "judge_counts": S.fx_verdicts(spark, sf).groupBy(F.col("judge").alias("key")).agg(F.count(F.lit(1)).alias("n"))}, path)
    return spark.read.schema("key string, n long, section string").json(path).select("section", "key", "n")


@register("export_setting_report")
def export_setting_report(spark, sf):
    """Setting summary and gap decomposition as (section, JSON record) rows."""
    from pairjudge.plans.q_metrics import gap_decomposition, setting_summary
    return IO.export_report({"setting_summary": setting_summary(spark, sf),
                             "gap_decomposition": gap_decomposition(spark, sf)})
