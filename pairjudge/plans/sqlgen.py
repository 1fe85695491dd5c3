"""DuckDB SQL builders for the oracle side of metric queries (plain string templates)."""

from __future__ import annotations


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END)"


def confusion_sql(src: str, keys: list[str], gold: str, pred: str, labels: list[str],
                  pred_labels: list[str] | None = None, label_col: str = "gold_label",
                  names: list[str] | None = None) -> str:
    pred_labels = pred_labels or labels
    names = names or pred_labels
    kk = ", ".join(keys)
    cells = ", ".join(f"count(*) FILTER (WHERE {gold} = {lit(g)} AND {pred} = {lit(p)}) AS c_{i}_{j}"
                      for i, g in enumerate(labels) for j, p in enumerate(pred_labels))
    agg = f"(SELECT {kk + ', ' if keys else ''}{cells} FROM {src}{' GROUP BY ' + kk if keys else ''})"
    parts = []
    for i, g in enumerate(labels):
        cols = ", ".join(f"c_{i}_{j} AS {q(n)}" for j, n in enumerate(names))
        parts.append(f"SELECT {kk + ', ' if keys else ''}{lit(g)} AS {q(label_col)}, {cols} FROM agg")
    return f"WITH agg AS {agg}\n" + "\nUNION ALL\n".join(parts)


def metrics_sql(src: str, keys: list[str], gold: str, pred: str, labels: list[str],
                names: list[str] | None = None, totals: bool = False) -> str:
    names = names or labels
    kk = ", ".join(keys)
    inl = ", ".join(lit(x) for x in labels)
    cnt = ["count(*) AS rows_scored", f"count(*) FILTER (WHERE {gold} = {pred}) AS correct"]
    for i, l in enumerate(labels):
        cnt += [f"count(*) FILTER (WHERE {gold} = {lit(l)} AND {pred} = {lit(l)}) AS tp_{i}",
                f"count(*) FILTER (WHERE {pred} = {lit(l)}) AS pred_{i}",
                f"count(*) FILTER (WHERE {gold} = {lit(l)}) AS true_{i}"]
    inner = (f"SELECT {kk + ', ' if keys else ''}{', '.join(cnt)} FROM {src} "
             f"WHERE {pred} IN ({inl}) AND {gold} IN ({inl}){' GROUP BY ' + kk if keys else ''}")
    prec = [div(f"tp_{i}", f"pred_{i}") for i in range(len(labels))]
    rec = [div(f"tp_{i}", f"true_{i}") for i in range(len(labels))]
    f1 = [div(f"2 * tp_{i}", f"true_{i} + pred_{i}") for i in range(len(labels))]
    sup = [f"true_{i}" for i in range(len(labels))]
    k = float(len(labels))
    cols = [*keys, "rows_scored", f"{div('correct', 'rows_scored')} AS accuracy"]
    for nm, vals in (("precision", prec), ("recall", rec), ("f1", f1)):
        cols.append(f"({' + '.join(vals)}) / {k} AS macro_{nm}")
    for nm, vals in (("precision", prec), ("recall", rec), ("f1", f1)):
        w = " + ".join(f"{v} * {s}" for v, s in zip(vals, sup))
        cols.append(f"{div(w, ' + '.join(sup))} AS weighted_{nm}")
    for i, n in enumerate(names):
        cols += [f"{prec[i]} AS precision_{n}", f"{rec[i]} AS recall_{n}", f"{f1[i]} AS f1_{n}"]
        if totals:
            cols += [f"true_{i} AS gold_{n}", f"pred_{i} AS pred_{n}"]
    cols.append("rows_scored - correct AS mismatches")
    return f"SELECT {', '.join(cols)} FROM ({inner})"
