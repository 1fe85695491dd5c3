"""Registered queries of the training-data operators, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pairjudge.llm import decontaminate, fill_middle, html_text, katz, language, merkle, packing, pii, repeated_spans, secrets, simhash, topk, training_order
from pairjudge.llm.common import ascii_lower, table

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("ranges")


OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bs),
lengths AS (SELECT DISTINCT n FROM bw),
ds AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
hits AS (SELECT rid, i, ds.n, item_id FROM (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM ds) AS ds JOIN bw USING (win)),
marked AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
          FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (rid) LEFT JOIN items USING (rid)
"""

def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(table(spark, sf_dir, "documents"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("secrets")
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", *[F.size(found[k]).cast("long").alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(found["base"], 256).alias("base_sha256"), found["spans"].alias("spans"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language.predict(documents, language.fit(language.training_rows(documents)))


def op8_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.remove_repeats(table(spark, sf_dir, "documents"))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(chosen, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), {"text": tampered})


#: Levels of 16 that the SQL below spells out: up to 16 ** 6 rows of a source, and as many sources.
_SQL_LEVELS = 6
_CRC32 = ("xor(4294967295, list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::BIGINT), "
          "lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT))")


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _fold_sql(tree: str, walk: str) -> str:
    """Tables tree1.. (nodes by level) and walk1.. (a row per document: place, proof and recomputed digest)."""
    out = []
    for k in range(_SQL_LEVELS):
        out.append(f"""{tree}r{k} AS (SELECT part, i // 16 AS i, any_value(n) AS n, string_agg(g, '' ORDER BY i) AS run FROM {tree}{k} GROUP BY part, i // 16),
{tree}{k + 1} AS (SELECT part, i, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN run ELSE sha256(run) END AS g FROM {tree}r{k}),
{walk}{k + 1} AS (SELECT w.* REPLACE (w.i // 16 AS i,
  CASE WHEN r.n = 1 THEN proof ELSE proof || substr(run, 1, 64 * (w.i % 16)) || substr(run, 64 * (w.i % 16) + 65) END AS proof,
  CASE WHEN r.n = 1 THEN f ELSE sha256(substr(run, 1, 64 * (w.i % 16)) || f || substr(run, 64 * (w.i % 16) + 65)) END AS f)
  FROM {walk}{k} AS w JOIN {tree}r{k} AS r ON r.part = w.part AND r.i = w.i // 16)""")
    return ",\n".join(out)


OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce('1' || source, '0') AS part, {_leaf_sql("text")} AS leaf,
  {_leaf_sql(f"(CASE WHEN {_CRC32} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END)")} AS f FROM documents),
w0 AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, '' AS proof FROM d),
t0 AS (SELECT part, i, leaf AS g, count(*) OVER (PARTITION BY part) AS n FROM w0),
{_fold_sql("t", "w")},
s0 AS (SELECT '' AS part, part AS name, g, row_number() OVER (ORDER BY part) - 1 AS i, count(*) OVER () AS n FROM t{_SQL_LEVELS}),
v0 AS (SELECT doc_id, leaf, f, proof, s0.part, s0.i, s0.g AS subroot FROM w{_SQL_LEVELS} AS w JOIN s0 ON s0.name = w.part),
{_fold_sql("s", "v")}
SELECT doc_id, leaf, subroot, s.g AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = s.g AS verified FROM v{_SQL_LEVELS} AS v, s{_SQL_LEVELS} AS s
"""


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.transform(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS u,
  ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2, ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""


def op13_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op13_katz": op13_katz,
    "op12_fill_middle": op12_fill_middle,
    "op11_merkle": op11_merkle,
    "op6_surrogates": op6_surrogates,
    "op8_repeated_spans": op8_repeated_spans,
    "op4_language": op4_language,
    "op3_main_text": op3_main_text,
    "op1_secrets": op1_secrets,
    "op2_training_order": op2_training_order,
    "op10_topk": op10_topk,
    "op7_packing": op7_packing,
    "op5_simhash": op5_simhash,
    "op9_decontamination": op9_decontamination,
}
ORACLE = {
    "op11_merkle": OP11_SQL,
    "op12_fill_middle": OP12_SQL,
    "op10_topk": OP10_SQL,
    "op9_decontamination": OP9_SQL,
}
