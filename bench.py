"""Benchmark the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion through the ``noop`` sink (full execution, nothing collected).
Headline set (SURVEY §6 targets): McNemar + kappa over every lineitem-sized rater row, exact
global rank / balanced order, bootstrap by cells at B = 10,000, classification metrics, and the
text-heavy screening and parsing paths.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pairjudge.operators import assign as A  # noqa: E402
from pairjudge.operators import resample as RS  # noqa: E402
from pairjudge.plans import QUERIES  # noqa: E402
from pairjudge.session import get_spark  # noqa: E402
from pairjudge.sources import tables as S  # noqa: E402

HEADLINE = ["mcnemar", "cohen_kappa", "exact_rank", "balanced_ab_hash", "balanced_ab_shuffle",
            "letter_metrics", "setting_summary", "category_pass", "dedupe_keep_last", "broken_flags",
            "parse_choice", "inspect_filter", "kappa_bootstrap_ci", "kappa_bootstrap_cells", "gold_agreement"]


def bootstrap_cells_big(spark, sf):
    """B = 10,000 percentile bootstrap of a 0/1 rate over every lineitem row, by cells."""
    return RS.binomial_bootstrap_rate(S.fx_raters_big(spark, sf), ["category"], "rater_a", B=10000, seed=42)


def balanced_order_big(spark, sf):
    """Exactly balanced A/B order over every lineitem row, by threshold."""
    return A.balanced_ab_hash(S.fx_raters_big(spark, sf), 42)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                      conf={"spark.driver.memory": "16g"})
    spark.range(1000).select(F.sum("id")).collect()
    runs = {name: QUERIES[name] for name in HEADLINE}
    runs["bootstrap_cells_600k"] = bootstrap_cells_big
    runs["balanced_order_600k"] = balanced_order_big
    # Warm-up (untimed): the same plans once on the smallest tables, so class loading and
    # whole-stage code generation are not billed to the first timed query.
    warm = os.path.join(os.path.dirname(sf), "sf0.001")
    if os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf):
        for fn in runs.values():
            fn(spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name, fn in runs.items():
        t0 = time.perf_counter()
        fn(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf_name = os.path.basename(sf)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_name.replace("sf", "") if sf_name.startswith("sf") else sf_name,
                      "cpus": cpus}))


if __name__ == "__main__":
    main()
