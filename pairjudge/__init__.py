"""pairjudge: pairwise preference evaluation on Spark.

Load paired answers and ratings, screen rows, assign a reproducible and exactly balanced A/B
order, render judge prompts, score rows with an injected batch model, parse verdicts, keep
resumable run tables and report metrics, agreement, significance and intervals. Everything is a
DataFrame -> DataFrame function over Spark SQL built-ins.
"""

from pairjudge.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
