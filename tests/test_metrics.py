"""Metric invariants and agreement with a direct computation."""

import pytest
from pyspark.sql import functions as F

from pairjudge.operators import metrics as M
from pairjudge.plans import QUERIES
from tests.conftest import SF_SMALL


def _manual(golds, preds, labels):
    rows = [(g, p) for g, p in zip(golds, preds) if p in labels and g in labels]
    n = len(rows)
    out = {"rows_scored": n, "accuracy": sum(g == p for g, p in rows) / n}
    ps, rs, fs, sup = [], [], [], []
    for lab in labels:
        tp = sum(1 for g, p in rows if g == lab and p == lab)
        pp = sum(1 for _, p in rows if p == lab)
        tt = sum(1 for g, _ in rows if g == lab)
        ps.append(tp / pp if pp else 0.0)
        rs.append(tp / tt if tt else 0.0)
        fs.append(2 * tp / (tt + pp) if tt + pp else 0.0)
        sup.append(tt)
    out["macro_f1"] = sum(fs) / len(fs)
    out["weighted_recall"] = sum(r * s for r, s in zip(rs, sup)) / sum(sup)
    out["precision_A"], out["recall_B"] = ps[0], rs[1]
    return out


def test_classification_metrics_match_manual(spark):
    golds = list("AABBABABBBAAAB") + ["A", "B"]
    preds = list("ABBBAAABBBBAAA") + [None, "C"]
    df = spark.createDataFrame(list(zip(["x"] * len(golds), golds, preds)), "k string, g string, p string")
    got = M.classification_metrics(df, ["k"], "g", "p", ["A", "B"]).first().asDict()
    want = _manual(golds, preds, ["A", "B"])
    for key, v in want.items():
        assert got[key] == pytest.approx(v)
    assert got["mismatches"] == got["rows_scored"] - round(got["accuracy"] * got["rows_scored"])


def test_zero_division_gives_zero(spark):
    df = spark.createDataFrame([("x", "A", "A")], "k string, g string, p string")
    got = M.classification_metrics(df, ["k"], "g", "p", ["A", "B"]).first()
    assert got["precision_B"] == 0.0 and got["recall_B"] == 0.0 and got["f1_B"] == 0.0


def test_confusion_sums_to_scored_rows(spark):
    conf = QUERIES["confusion_matrix"](spark, SF_SMALL)
    tot = conf.groupBy("judge", "dimension").agg((F.sum("A") + F.sum("B")).alias("t"))
    ms = QUERIES["match_summary"](spark, SF_SMALL)
    j = tot.join(ms, ["judge", "dimension"]).where(F.col("t") != F.col("scored"))
    assert j.count() == 0


def test_kappa_symmetric(spark):
    from pairjudge.operators import agreement as AG
    df = spark.createDataFrame([(i % 3, (i * 7) % 2, i % 2) for i in range(200)], "g int, a int, b int")
    k1 = {r["g"]: r["kappa"] for r in AG.cohen_kappa(df, "a", "b", ["g"]).collect()}
    k2 = {r["g"]: r["kappa"] for r in AG.cohen_kappa(df, "b", "a", ["g"]).collect()}
    for g in k1:
        assert k1[g] == pytest.approx(k2[g])


def test_label_kappa_equals_binary_kappa(spark):
    from pairjudge.operators import agreement as AG
    df = spark.createDataFrame([("g", i % 2, (i // 3) % 2) for i in range(90)], "g string, a int, b int")
    kb = AG.cohen_kappa(df, "a", "b", ["g"]).first()["kappa"]
    kl = AG.cohen_kappa_labels(df.select("g", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")),
                               "a", "b", ["g"]).first()["kappa"]
    assert kb == pytest.approx(kl)


def test_outcome_invariants(spark):
    s = QUERIES["setting_summary"](spark, SF_SMALL).collect()
    for r in s:
        assert r["sqi"] <= min(r["qual_gen"], r["fp"])
        assert r["fp"] <= min(r["pres"], r["nounsupp"])
    f = QUERIES["factual_summary"](spark, SF_SMALL).collect()
    for r in f:
        assert r["preserved_yes"] + r["preserved_no"] == r["rows_checked"]
        assert r["additions_yes"] + r["additions_no"] == r["rows_checked"]
    fm = QUERIES["factual_matrix"](spark, SF_SMALL).groupBy("judge").agg(
        (F.sum("no_unsupported_additions") + F.sum("unsupported_additions")).alias("t")).collect()
    checked = {r["judge"]: r["rows_checked"] for r in f}
    for r in fm:
        assert r["t"] == checked[r["judge"]]


def test_unanswered_fail_vs_exclude(spark):
    from pairjudge.operators import verdicts as V
    rows = [("j", "1", "Generated", "Original", "Yes", "No"), ("j", "2", None, "Generated", None, "No"),
            ("j", "3", "Original", None, "No", None)]
    w = spark.createDataFrame(rows, "judge string, item_id string, empathy string, quality string, "
                                    "preservation string, unsupported_addition string")
    fail = {r["item_id"]: r for r in V.derive_outcomes(w, ["judge", "item_id"], "fail").collect()}
    excl = {r["item_id"]: r for r in V.derive_outcomes(w, ["judge", "item_id"], "exclude").collect()}
    assert fail["2"]["emp_gen"] == 0 and excl["2"]["emp_gen"] is None
    assert fail["1"]["fp"] == 1 and fail["1"]["sqi"] == 0
    assert fail["3"]["fp"] == 0 and excl["3"]["fp"] is None
    assert excl["1"]["fp"] == 1
