"""Example: a two-source calibration run on your own files, end to end.

    python examples/calibration_report.py ratings.csv out_dir

``ratings.csv`` holds one row per (item, source, dimension, evaluator) with columns
``item_id, question, source, dimension, evaluator, score_raw, answer``. The run derives the gold
source per item, assigns the balanced A/B order, renders the judge prompt, scores it with the
injected scorer (offline stand-in here), parses the verdicts and writes letter/source metrics and
Wilson intervals. Every step is a Spark job; nothing is collected but the final small tables.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from pairjudge import get_spark  # noqa: E402
from pairjudge.functions import prompts as P  # noqa: E402
from pairjudge.functions import stats as ST  # noqa: E402
from pairjudge.functions import text as T  # noqa: E402
from pairjudge.operators import assign as A  # noqa: E402
from pairjudge.operators import metrics as M  # noqa: E402
from pairjudge.operators import scoring as SC  # noqa: E402
from pairjudge.operators import screen as SCR  # noqa: E402
from pairjudge.operators import verdicts as V  # noqa: E402
from pairjudge.sources import io as IO  # noqa: E402

SCHEMA = ("item_id string, question string, source string, dimension string, evaluator int, "
          "score_raw string, answer string")


def main(src: str, out: str, seed: int = 42, variant: str = "paper_minimal") -> None:
    spark = get_spark()
    rows = IO.require_columns(IO.read_table(spark, src, SCHEMA), ["item_id", "source", "dimension", "score_raw"])
    gold = SCR.average_scores(rows).where(F.col("gold_source") != "Tie")
    texts = rows.groupBy("item_id").agg(
        F.first("question", ignorenulls=True).alias("question"),
        F.first(F.when(F.col("source") == "Physician", F.col("answer")), ignorenulls=True).alias("physician"),
        F.first(F.when(F.col("source") == "ChatGPT", F.col("answer")), ignorenulls=True).alias("chatgpt"))
    order = A.balanced_ab_shuffle(gold, seed, target_col="gold_source", keys=["dimension"]).join(texts, "item_id")
    a = F.when(F.col("sentence_a_source") == "ChatGPT", F.col("chatgpt")).otherwise(F.col("physician"))
    b = F.when(F.col("sentence_b_source") == "ChatGPT", F.col("chatgpt")).otherwise(F.col("physician"))
    dim = F.lower(F.col("dimension"))
    tpls = {d: P.template("calibration", f"{variant}:{d}")[1] for d in ("empathy", "quality")}
    user = F.when(dim == "quality", P.render(tpls["quality"], question=F.col("question"), sentence_a=a, sentence_b=b)) \
            .otherwise(P.render(tpls["empathy"], question=F.col("question"), sentence_a=a, sentence_b=b))
    units = order.select("item_id", "dimension", "gold_source", "gold_choice", "response_order",
                         F.lit(P.JUDGE_SYSTEM).alias("system"), user.alias("user"))
    scored = SC.materialize(SC.score_rows(units), "calibration-verdicts")
    view = scored.withColumn("pred_choice", T.parse_choice("raw_response")).withColumn(
        "pred_source", V.pred_source_from_order(F.col("response_order"), F.col("pred_choice")))
    letters = M.classification_metrics(view, ["dimension"], "gold_choice", "pred_choice", ["A", "B"])
    sources = M.classification_metrics(view, ["dimension"], "gold_source", "pred_source", ["Physician", "ChatGPT"],
                                       ["physician", "chatgpt"], totals=True)
    ok = F.col("rows_scored") - F.col("mismatches")
    acc = letters.select("dimension", "rows_scored", "accuracy", ST.wilson_low(ok, "rows_scored").alias("ci_low"),
                         ST.wilson_high(ok, "rows_scored").alias("ci_high"))
    for name, df in (("letter_metrics", letters), ("source_metrics", sources), ("accuracy", acc)):
        IO.write_csv(df, os.path.join(out, name))
    IO.export_report({"letter_metrics": letters, "source_metrics": sources, "accuracy": acc}) \
        .write.mode("overwrite").json(os.path.join(out, "report"))


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2])
