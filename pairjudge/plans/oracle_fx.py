"""Fixture views in DuckDB SQL, prepended as CTEs to every oracle query.

These are independent SQL statements of the same fixtures the Spark side builds with the
DataFrame API in ``pairjudge.sources.tables`` (an oracle must not share code with the subject).
"""

from __future__ import annotations

FX: dict[str, tuple[list[str], str]] = {
    "fx_pairs": ([], """
SELECT concat('c', CAST(u.conv_id AS VARCHAR), '_', CAST(u.turn AS VARCHAR)) AS item_id,
       concat('cat', substr(md5(CAST(u.conv_id AS VARCHAR)), 1, 1)) AS category,
       u.text AS question, a.text AS original_answer,
       CASE WHEN substr(md5(a.text), 1, 1) = '0' THEN ''
            WHEN substr(md5(a.text), 1, 1) < '9' THEN concat('I understand your concern. ', a.text)
            ELSE concat('I understand your concern. ', a.text, ' Please take good care of yourself.') END
         AS generated_answer
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""),
    "fx_verdicts": (["fx_pairs"], """
SELECT p.item_id, p.category, j.judge, d.dimension,
  CASE WHEN d.dimension IN ('empathy', 'quality') THEN
    CASE substr(md5(concat_ws('||', j.judge, d.dimension, p.item_id)), 1, 1)
      WHEN '9' THEN 'A.' WHEN 'a' THEN 'Answer: B' WHEN 'b' THEN '**A**' WHEN 'c' THEN 'b'
      WHEN 'd' THEN 'cannot decide' WHEN 'e' THEN '' WHEN 'f' THEN NULL
      ELSE CASE WHEN substr(md5(concat_ws('||', j.judge, d.dimension, p.item_id)), 2, 1) < '9'
                THEN 'A' ELSE 'B' END END
  ELSE
    CASE substr(md5(concat_ws('||', j.judge, d.dimension, p.item_id)), 1, 1)
      WHEN 'a' THEN 'Yes.' WHEN 'b' THEN 'no, it does not' WHEN 'c' THEN 'Answer: YES'
      WHEN 'd' THEN 'unclear' WHEN 'e' THEN '' WHEN 'f' THEN NULL
      ELSE CASE WHEN d.dimension = 'preservation' THEN 'Yes' ELSE 'No' END END
  END AS raw_response
FROM fx_pairs p
CROSS JOIN (VALUES ('j1'), ('j2')) AS j(judge)
CROSS JOIN (VALUES ('empathy'), ('quality'), ('preservation'), ('unsupported_addition')) AS d(dimension)"""),
    "fx_rephrase": ([], """
SELECT CAST(doc_id AS VARCHAR) AS item_id, lang, text AS normal_answer,
  CASE substr(md5(CAST(doc_id AS VARCHAR)), 1, 1)
    WHEN '0' THEN substr(text, 1, 20) WHEN '1' THEN concat(text, ' come:')
    WHEN '2' THEN concat('# Utente ', text) WHEN '3' THEN substr(text, 1, 70)
    WHEN '4' THEN concat(text, ' the breast cancer symptoms and the stage with surgery or without answer ')
    ELSE concat('I see. ', text) END AS empathy_answer,
  CASE substr(md5(CAST(doc_id AS VARCHAR)), 2, 1)
    WHEN '0' THEN '1' WHEN '1' THEN '2' WHEN '2' THEN '3 - medio' WHEN '3' THEN NULL
    WHEN '4' THEN 'boh' WHEN '5' THEN '5/5' ELSE '4 (alto)' END AS increment_raw
FROM documents"""),
    "fx_ratings": ([], """
SELECT CAST(t.doc_id AS VARCHAR) AS item_id, s.source, d.dimension, e.evaluator,
  CASE WHEN substr(md5(concat_ws('||', t.doc_id, s.source, d.dimension, e.evaluator)), 2, 1) = '0' THEN 'n/a'
       ELSE CAST(1 + (instr('0123456789abcdef',
              substr(md5(concat_ws('||', t.doc_id, s.source, d.dimension, e.evaluator)), 1, 1)) - 1) % 5 AS VARCHAR)
  END AS score_raw
FROM documents t
CROSS JOIN (VALUES ('Physician'), ('ChatGPT')) AS s(source)
CROSS JOIN (VALUES ('Empathy'), ('Quality')) AS d(dimension)
CROSS JOIN (VALUES (1), (2), (3)) AS e(evaluator)"""),
    "fx_raters": ([], """
SELECT CAST(l.doc_id AS VARCHAR) AS item_id, t.lang AS category, l.quality AS preserved,
  l.toxic AS unsupported, l.quality AS rater_a,
  CASE WHEN substr(md5(CAST(l.doc_id AS VARCHAR)), 1, 1) < '3' THEN 1 - l.quality ELSE l.quality END AS rater_b
FROM labels l JOIN documents t ON t.doc_id = l.doc_id"""),
    "fx_raters_big": ([], """
SELECT concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS item_id, l_linestatus AS category,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS rater_a,
  CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS rater_b, l_quantity AS x
FROM lineitem"""),
    "fx_results": ([], """
SELECT CAST(user_id AS VARCHAR) AS item_id, event_type AS judge_model,
  CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'paper_minimal' ELSE 'guided' END AS prompt_variant,
  ts AS scored_at, event_id AS seq, value
FROM events"""),
}


def with_fx(sql: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``sql`` with the CTEs for the named fixtures (dependencies first), then ``extra``
    (name, body) CTEs in the given order."""
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in FX[n][0]:
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = [f"{n} AS ({FX[n][1]}\n)" for n in order] + [f"{n} AS ({body}\n)" for n, body in (extra or [])]
    return ("WITH " + ",\n".join(ctes) + "\n" + sql) if ctes else sql
