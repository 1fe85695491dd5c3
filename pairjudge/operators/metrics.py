"""Confusion cells and classification metrics.

The single primitive is a one-pass aggregation of ``count_if`` per (gold label, predicted label)
pair: zero-filled for fixed labels, no pivot-distinct job and no join to a label spine. All
metrics are closed-form arithmetic on those counts (0 on zero division, as the evaluated code).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def confusion(df: DataFrame, keys: list[str], gold: Column, pred: Column, labels: list[str],
              pred_labels: list[str] | None = None, label_col: str = "gold_label",
              names: list[str] | None = None) -> DataFrame:
    """One row per (keys, gold label) and one count column per predicted label; rows whose
    labels are outside the fixed lists are dropped."""
    pred_labels = pred_labels or labels
    names = names or pred_labels
    aggs = [F.count_if((gold == g) & (pred == p)).alias(f"c_{i}_{j}")
            for i, g in enumerate(labels) for j, p in enumerate(pred_labels)]
    agg = df.groupBy(*keys).agg(*aggs)
    parts = []
    for i, g in enumerate(labels):
        parts.append(_lit(g))
        parts.extend(f"c_{i}_{j}" for j in range(len(pred_labels)))
    stack = f"stack({len(labels)}, {', '.join(parts)}) AS ({_q(label_col)}, {', '.join(_q(n) for n in names)})"
    return agg.select(*keys, F.expr(stack))


def label_counts(df: DataFrame, keys: list[str], gold: Column, pred: Column, labels: list[str]) -> DataFrame:
    """Per label: true positives, predicted and true totals; plus rows and correct rows."""
    aggs = [F.count(F.lit(1)).alias("rows_scored"), F.count_if(gold == pred).alias("correct")]
    for i, l in enumerate(labels):
        aggs += [F.count_if((gold == l) & (pred == l)).alias(f"tp_{i}"),
                 F.count_if(pred == l).alias(f"pred_{i}"), F.count_if(gold == l).alias(f"true_{i}")]
    return df.groupBy(*keys).agg(*aggs)


def _div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def classification_metrics(df: DataFrame, keys: list[str], gold: str, pred: str, labels: list[str],
                           names: list[str] | None = None, only_labelled: bool = True,
                           totals: bool = False) -> DataFrame:
    """rows_scored, accuracy, macro / weighted precision-recall-F1, per-label precision / recall /
    F1 and mismatches, over rows whose prediction (and gold) is one of ``labels``."""
    names = names or labels
    g, p = F.col(gold), F.col(pred)
    x = df.where(p.isin(*labels) & g.isin(*labels)) if only_labelled else df
    c = label_counts(x, keys, g, p, labels)
    cols = [*[F.col(k) for k in keys], F.col("rows_scored"),
            _div(F.col("correct"), F.col("rows_scored")).alias("accuracy")]
    prec, rec, f1, sup = [], [], [], []
    for i, _ in enumerate(labels):
        tp, pr, tr = F.col(f"tp_{i}"), F.col(f"pred_{i}"), F.col(f"true_{i}")
        prec.append(_div(tp, pr))
        rec.append(_div(tp, tr))
        f1.append(_div(2 * tp, tr + pr))
        sup.append(tr)
    k = float(len(labels))
    total_sup = sum(sup[1:], sup[0])
    for nm, vals in (("precision", prec), ("recall", rec), ("f1", f1)):
        cols.append((sum(vals[1:], vals[0]) / k).alias(f"macro_{nm}"))
    for nm, vals in (("precision", prec), ("recall", rec), ("f1", f1)):
        w = sum([v * s for v, s in zip(vals, sup)][1:], vals[0] * sup[0])
        cols.append(_div(w, total_sup).alias(f"weighted_{nm}"))
    for i, n in enumerate(names):
        cols += [prec[i].alias(f"precision_{n}"), rec[i].alias(f"recall_{n}"), f1[i].alias(f"f1_{n}")]
        if totals:
            cols += [F.col(f"true_{i}").alias(f"gold_{n}"), F.col(f"pred_{i}").alias(f"pred_{n}")]
    cols.append((F.col("rows_scored") - F.col("correct")).alias("mismatches"))
    return c.select(*cols)


def metric_table(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Report rows: one per label plus 'macro avg' and 'weighted avg' (precision, recall, f1)."""
    parts = []
    for n in names:
        parts += [_lit(n), f"precision_{n}", f"recall_{n}", f"f1_{n}"]
    for agg_name, prefix in (("macro avg", "macro"), ("weighted avg", "weighted")):
        parts += [_lit(agg_name), f"{prefix}_precision", f"{prefix}_recall", f"{prefix}_f1"]
    stack = f"stack({len(names) + 2}, {', '.join(parts)}) AS (label, precision, recall, f1)"
    return metrics.select(*keys, F.expr(stack))
