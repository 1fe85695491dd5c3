"""Reproducible, exactly balanced A/B order assignment.

A balanced order only asks whether a row is among the m smallest by a uniform hex hash.
:func:`among_smallest` finds the threshold (the m-th smallest hash and id) from counts per hash
bucket and a sort of the one bucket that holds it; rows, with whatever long texts they carry, are
then compared with it where they are, without a shuffle.

:func:`exact_rank` is a deterministic global rank without an unpartitioned window (which would pull
every row into one task). Rows are bucketed by the first hex digits of the hash; a per-bucket count
table (at most 16**digits rows, a proven bound) gives each bucket its running offset and is
broadcast; ``row_number`` runs inside each bucket.

Key columns may be NULL: NULL is a key like any other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairjudge.functions.text import hash_coin

BUCKET_DIGITS = 4          # 65,536 buckets; the offset table is <= 65,536 rows (~1 MB broadcast)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; the right side's key columns are dropped."""
    renamed = right.withColumnsRenamed({k: f"_nsj_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_nsj_{k}"]) for k in keys])
    joined = left.join(renamed, same, how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*[f"_nsj_{k}" for k in keys])


def among_smallest(df: DataFrame, hash_col: str, id_col: str, quota: Callable[[Column], Column],
                   keys: list[str] | None = None, digits: int = BUCKET_DIGITS, population: DataFrame | None = None) -> Column:
    """Condition on the rows of ``df``: is (``hash_col``, ``id_col``) among the ``quota(n)`` smallest
    of its ``keys`` group of n rows?

    ``hash_col`` must be a lower-case hex string of uniform hash digits and ids unique. ``keys``
    must have few distinct values: the thresholds, one per key, are scalar subqueries. They are found
    in two passes over these columns of ``df``, or of ``population``: the same rows where reading
    them is cheap, if ``df`` takes work.
    """
    keys = list(keys or [])
    bucket = F.substring(F.col(hash_col), 1, digits)
    key = F.struct(*[F.col(k) for k in keys], F.lit(0).alias("_all"))
    rows = (df if population is None else population).select(*keys, hash_col, id_col)
    counts = rows.groupBy(*keys, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    # Windows over counts: keys x 16**digits rows at most.
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b"))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    cut = (counts.select(*keys, "_b", "_n", upto.alias("_upto"), quota(total).alias("_m"))
           .where((F.col("_upto") >= F.col("_m")) & (F.col("_upto") - F.col("_n") < F.col("_m"))))
    cuts = cut.agg(F.map_from_entries(F.collect_list(F.struct(
        key.alias("k"), F.struct("_b", (F.col("_m") - F.col("_upto") + F.col("_n")).alias("_need")).alias("v"))))).scalar()
    # The bucket that holds the threshold: about n / 16**digits rows.
    inside = rows.withColumn("_cut", F.try_element_at(cuts, key)).where(bucket.eqNullSafe(F.col("_cut._b")) & F.col("_cut").isNotNull())
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(hash_col, id_col))
    last = inside.withColumn("_place", place).where(F.col("_place") == F.col("_cut._need"))
    thresholds = last.agg(F.map_from_entries(F.collect_list(F.struct(
        key.alias("k"), F.struct(F.col(hash_col).alias("h"), F.col(id_col).alias("i")).alias("v"))))).scalar()
    own = F.struct(F.col(hash_col).alias("h"), F.col(id_col).alias("i"))
    return F.coalesce(own <= F.try_element_at(thresholds, key), F.lit(False))


def exact_rank(df: DataFrame, hash_col: str, tiebreak: list[str], out: str = "rank",
               digits: int = BUCKET_DIGITS, total_col: str | None = None,
               keys: list[str] | None = None, checkpoint_input: bool = False) -> DataFrame:
    """Add ``out`` = 1-based rank of (``hash_col``, *tiebreak) within each ``keys`` group (whole
    DataFrame when no keys).

    ``hash_col`` must be a lower-case hex string of uniform hash digits (md5), so buckets are
    balanced; ``total_col`` optionally carries the group's row count to every row. ``keys`` must
    have few distinct values (dimensions, seeds): the offset table has keys x 16**digits rows.

    The count pass and the rank pass both read ``df``; shuffles in its lineage are reused, but
    narrow work after the last shuffle runs twice. For an expensive narrow input (e.g. text
    screening) pass ``checkpoint_input=True``: it is written once to the shared checkpoint folder.
    """
    if checkpoint_input:
        from pairjudge.session import checkpoint_dir
        checkpoint_dir(df.sparkSession)
        df = df.checkpoint()
    keys = list(keys or [])
    bkt = "_rk_bucket"
    x = df.withColumn(bkt, F.substring(F.col(hash_col), 1, digits))
    counts = x.groupBy(*keys, bkt).agg(F.count(F.lit(1)).alias("_rk_n"))
    # Bounded table (keys x 16**digits rows): a window over it is cheap wherever it runs.
    w_prev = Window.partitionBy(*keys).orderBy(bkt).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*keys, bkt, F.coalesce(F.sum("_rk_n").over(w_prev), F.lit(0)).alias("_rk_off"),
                         F.sum("_rk_n").over(Window.partitionBy(*keys)).alias("_rk_total"))
    # Without keys the offset table has at most 16**digits rows: broadcast it. With keys its size
    # grows with the key count, so the broadcast decision is left to AQE's runtime size check.
    offs = offs if keys else F.broadcast(offs)
    ranked = join_null_safe(x, offs, [*keys, bkt]).withColumn(
        out, F.row_number().over(Window.partitionBy(*keys, bkt).orderBy(hash_col, *tiebreak))
        + F.col("_rk_off"))
    if total_col:
        ranked = ranked.withColumnRenamed("_rk_total", total_col)
    return ranked.drop(bkt, "_rk_off", "_rk_total")


def _order_cols(target_is_a: Column, target: str, other: str) -> list[Column]:
    return [
        target_is_a.alias("target_is_a"),
        F.when(target_is_a, F.lit("A")).otherwise(F.lit("B")).alias("gold_choice"),
        F.when(target_is_a, F.lit(f"{target}_A__{other}_B"))
         .otherwise(F.lit(f"{other}_A__{target}_B")).alias("response_order"),
        F.when(target_is_a, F.lit(target)).otherwise(F.lit(other)).alias("sentence_a_source"),
        F.when(target_is_a, F.lit(other)).otherwise(F.lit(target)).alias("sentence_b_source"),
    ]


def balanced_ab_hash(items: DataFrame, seed: int, id_col: str = "item_id",
                     target: str = "Generated", other: str = "Original", sep: str = "||",
                     keys: list[str] | None = None, ids: DataFrame | None = None) -> DataFrame:
    """The floor(n/2) items with the smallest md5('{seed}{sep}{id}') get the target at A. ``ids``: the
    items' id and key columns, written somewhere, if ``items`` takes work."""
    h = F.md5(F.concat_ws(sep, F.lit(str(seed)), F.col(id_col).cast("string")))
    x = items.withColumn("_ab_h", h)
    is_a = among_smallest(x, "_ab_h", id_col, lambda n: F.floor(n / 2), keys,
                          population=None if ids is None else ids.withColumn("_ab_h", h))
    return x.withColumn("_ab_a", is_a).select(*items.columns, F.lit(seed).alias("seed"),
                                              *_order_cols(F.col("_ab_a"), target, other))


def nth_position(spark: SparkSession, seed: int, n: int, nth: int, digits: int = BUCKET_DIGITS, most: int = 10_000) -> tuple[str, int]:
    """(hash, i) of the ``nth`` smallest of the positions 0 .. n - 1 by the 48-bit md5('{seed}:position:{i}') and i.

    The positions are generated, dealt over tasks and counted by the leading hex digits of their hashes, ``digits`` at a time
    (16**digits counts at most), until the hashes that are left to sort are ``most`` at most."""
    rows = spark.range(n).select(F.substring(F.md5(F.concat(F.lit(f"{seed}:position:"), F.col("id").cast("string"))), 1, 12).alias("h"), "id")
    prefix, left = "", n
    while left > most and len(prefix) < 12:
        digit = F.substring("h", len(prefix) + 1, digits).alias("d")
        for r in sorted(rows.where(F.col("h").startswith(prefix)).groupBy(digit).agg(F.count(F.lit(1)).alias("n")).collect()):
            if nth <= r["n"]:
                break
            nth -= r["n"]
        prefix, left = prefix + r["d"], r["n"]
    return tuple(sorted(rows.where(F.col("h").startswith(prefix)).collect())[nth - 1])


def balanced_ab_shuffle(items: DataFrame, seed: int, id_col: str = "item_id",
                        target_col: str | None = None, target: str = "ChatGPT",
                        other: str = "Physician", keys: list[str] | None = None) -> DataFrame:
    """Two-source calibration order: sort by 48-bit md5('{seed}:{id}'); the number of gold-at-A
    rows is floor(n/2), plus one when n is odd and the seed even; sorted position i gets gold at
    A iff the rank of md5('{seed}:position:{i}') is below that number.

    ``target_col`` (e.g. ``gold_source``) names, per row, which source is the gold one; the
    other source is then the remaining label of (target, other).

    The items are counted by hash bucket at once (a job; 65,536 counts a key at most come to the driver: ``keys`` must
    have few distinct values, and ``items`` should be cheap to read twice). These give the offsets of the ranks, and n; the threshold over
    the positions depends on n alone (:func:`nth_position`), so the plan returned ranks the ids once and compares.
    """
    keys, spark = list(keys or []), items.sparkSession
    rows_id = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    x = items.withColumn("_sh_h", F.substring(F.md5(F.concat(F.lit(f"{seed}:"), rows_id)), 1, 12))
    x = x.withColumn("_sh_b", F.substring("_sh_h", 1, BUCKET_DIGITS))
    counts = x.groupBy(*keys, "_sh_b").agg(F.count(F.lit(1)).alias("n")).collect()
    totals: dict[tuple, int] = {}
    offsets = []
    for r in sorted(counts, key=lambda r: r["_sh_b"]):
        key = tuple(r[k] for k in keys)
        offsets.append((*key, r["_sh_b"], totals.get(key, 0)))
        totals[key] = totals.get(key, 0) + r["n"]
    schema = T.StructType([*(items.schema[k] for k in keys), T.StructField("_sh_b", T.StringType()), T.StructField("_sh_o", T.LongType())])
    cuts: dict[int, tuple[str, int]] = {}
    for n in set(totals.values()):
        quota = n // 2 + (1 if n % 2 and seed % 2 == 0 else 0)
        if quota:
            cuts[n] = nth_position(spark, seed, n, quota)
    place = F.row_number().over(Window.partitionBy(*keys, "_sh_b").orderBy("_sh_h", id_col)) - 1
    r = join_null_safe(x, F.broadcast(spark.createDataFrame(offsets, schema)), [*keys, "_sh_b"]).withColumn("_sh_i", place + F.col("_sh_o"))
    position = F.struct(F.substring(F.md5(F.concat(F.lit(f"{seed}:position:"), F.col("_sh_i").cast("string"))), 1, 12).alias("h"), F.col("_sh_i").alias("i"))
    is_first = F.lit(False)
    for key, n in totals.items():
        if n in cuts:
            own = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, key)], F.lit(True))
            cut = F.struct(F.lit(cuts[n][0]).alias("h"), F.lit(cuts[n][1]).cast("long").alias("i"))
            is_first = F.when(own, position <= cut).otherwise(is_first)
    r = r.withColumn("_sh_a", is_first)
    is_a = F.col("_sh_a")
    if target_col is None:
        cols = _order_cols(is_a, target, other)
    else:
        g = F.col(target_col)
        o = F.when(g == target, F.lit(other)).otherwise(F.lit(target))
        cols = [is_a.alias("target_is_a"),
                F.when(is_a, F.lit("A")).otherwise(F.lit("B")).alias("gold_choice"),
                F.when(is_a, F.concat(g, F.lit("_A__"), o, F.lit("_B")))
                 .otherwise(F.concat(o, F.lit("_A__"), g, F.lit("_B"))).alias("response_order"),
                F.when(is_a, g).otherwise(o).alias("sentence_a_source"),
                F.when(is_a, o).otherwise(g).alias("sentence_b_source")]
    return r.select(*items.columns, F.lit(seed).alias("seed"), *cols)


def balanced_ab_random(items: DataFrame, seed: int, id_col: str = "item_id",
                       target: str = "answer_with_empathy", other: str = "answer",
                       keys: list[str] | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Rephrasing calibration order: exactly floor(n/2) items put the rewrite at A.

    The evaluated script draws the positions with a single-process random shuffle, which cannot
    be reproduced in parallel; we draw them by hash rank (same guarantee, different draw).
    """
    return balanced_ab_hash(items, seed, id_col, target, other, sep=":", keys=keys, ids=ids)


def coin_order(items: DataFrame, seed: int, id_col: str = "item_id",
               target: str = "Generated", other: str = "Original") -> DataFrame:
    """Per-row fallback order: the target is at A when the seeded hash coin is False."""
    is_a = ~hash_coin(F.lit(seed), F.col(id_col))
    return items.select(*items.columns, F.lit(seed).alias("seed"), *_order_cols(is_a, target, other))


def balance_check(assigned: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Gold-letter counts per key (zero-filled A and B rows) in one aggregation."""
    keys = keys or []
    agg = assigned.groupBy(*keys).agg(
        F.count_if(F.col("gold_choice") == "A").alias("A"),
        F.count_if(F.col("gold_choice") == "B").alias("B"))
    return agg.select(*keys, F.expr("stack(2, 'A', A, 'B', B) AS (gold_choice, n)"))


def pick_response(letter_source: Column, generated: Column, original: Column,
                  target: str = "Generated") -> Column:
    """Text shown at a letter, given the source name placed at that letter."""
    return F.when(letter_source == target, generated).otherwise(original)


def ab_sentences(assigned: DataFrame, target_text: str, other_text: str) -> DataFrame:
    """Add sentence_a / sentence_b from the order (target text at A when ``target_is_a``)."""
    t = F.col("target_is_a")
    return assigned.withColumn("sentence_a", F.when(t, F.col(target_text)).otherwise(F.col(other_text))) \
                   .withColumn("sentence_b", F.when(t, F.col(other_text)).otherwise(F.col(target_text)))
