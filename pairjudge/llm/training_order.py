"""Training-order materialisation of token-id sequences.

Every document's ids (and the end id) are cut into sequences of ``SEQUENCE`` ids, the last padded, and
stored as records of a fixed stride (little-endian unsigned 16-bit ids, and a line feed). A keyed Feistel network
permutes [0, 2^b); walking its cycles until the number falls below the number of sequences gives a
permutation of exactly those, so every sequence has its own slot of the training order, known from its
number and the key alone. Slots are cut into shards of ``PER_SHARD``; a range partitioning by slot and a
sort inside partitions put each shard's records one after another into one file, that Spark's text writer commits: the record of a slot is in
the file of shard slot // PER_SHARD at byte (slot % PER_SHARD) * stride.

A reader that stopped seeks to its next slot; a writer that stopped writes the shards that are
not there yet. The numbers of the sequences are written beside the shards before the first of them, so a writer that goes
on with other cores or splits gives every sequence the slot it had.

Defined results: a null or empty text is one sequence with the end id alone; repeated rows get a
sequence each; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairjudge.llm.common import out_batch, slices, strings, written
from pairjudge.llm.tokens import END, VOCABULARY, document_ids
from pairjudge.sources import files

SEQUENCE = 512
PER_SHARD = 4096
ROUNDS = 6
KEY = 20240229

RECORDS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("doc_id", T.LongType()),
    T.StructField("piece", T.IntegerType()), T.StructField("n_ids", T.IntegerType()), T.StructField("crc32", T.LongType()),
    T.StructField("record", T.BinaryType())])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _half_bits(n: int) -> int:
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _feistel(x: np.ndarray, half: int, key: int, backward: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for r in reversed(range(ROUNDS)) if backward else range(ROUNDS):
        round_key = np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % (1 << 64))
        if backward:
            left, right = right ^ (_mix(left ^ round_key) & mask), left
        else:
            left, right = right, left ^ (_mix(right ^ round_key) & mask)
    return (left << np.uint64(half)) | right


def permute(numbers: np.ndarray, n: int, key: int = KEY, backward: bool = False) -> np.ndarray:
    """Keyed permutation of 0..n-1 (``backward``: its inverse)."""
    half = _half_bits(n)
    out = _feistel(np.asarray(numbers, dtype=np.uint64), half, key, backward)
    while len(away := np.flatnonzero(out >= np.uint64(n))):  # walk the cycle back into the range
        out[away] = _feistel(out[away], half, key, backward)
    return out.astype(np.int64)


def records(documents: DataFrame, sequence: int = SEQUENCE, vocabulary: str = VOCABULARY) -> DataFrame:
    """Fixed-stride records of every document, each with its task and its place in that task's rows."""

    def task(batches):
        part, place = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            cols: dict[str, list] = {f.name: [] for f in RECORDS}
            for doc, text in zip(strings(batch.column("doc_id")), strings(batch.column("text"))):
                ids = document_ids(text, vocabulary)
                if len(ids) and ids.max() >= 1 << 16:
                    raise ValueError("records hold ids under 65,536")
                for k, start in enumerate(range(0, len(ids), sequence)):
                    held = ids[start:start + sequence].astype("<u2")
                    record = np.full(sequence, END, dtype="<u2")
                    record[: len(held)] = held
                    cols["part"].append(part)
                    cols["place"].append(place)
                    cols["doc_id"].append(doc)
                    cols["piece"].append(k)
                    cols["n_ids"].append(len(held))
                    cols["crc32"].append(zlib.crc32(record.tobytes()))
                    cols["record"].append(record.tobytes())
                    place += 1
            yield out_batch(RECORDS, cols)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, RECORDS)


def stride(sequence: int = SEQUENCE) -> int:
    return 2 * sequence + 1


def numbered(held: DataFrame) -> tuple[DataFrame, int]:
    """Written records with ``number`` 0, 1, 2, ..., and how many there are."""
    spark = held.sparkSession
    starts, n = [], 0
    for r in held.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row per task
        starts.append((r["part"], n))
        n += r["n"]
    first = spark.createDataFrame(starts, "part int, first long")
    return held.join(F.broadcast(first), "part").withColumn("number", F.col("first") + F.col("place")).drop("first", "part", "place"), n


def training_order(documents: DataFrame, key: int = KEY, sequence: int = SEQUENCE, per_shard: int = PER_SHARD,
                   vocabulary: str = VOCABULARY) -> DataFrame:
    """slot, shard, offset (bytes), doc_id, piece, n_ids, crc32, record: in slot order, range by range."""
    return in_order(written(records(documents, sequence, vocabulary), "records"), key, sequence, per_shard)


def in_order(records: DataFrame, key: int = KEY, sequence: int = SEQUENCE, per_shard: int = PER_SHARD) -> DataFrame:
    """The training order of written records."""
    held, n = numbered(records)

    @F.pandas_udf("long")
    def slot(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), n, key))

    out = (held.withColumn("slot", slot("number")).drop("number")
           .withColumn("shard", F.floor(F.col("slot") / per_shard).cast("long"))
           .withColumn("offset", F.col("slot") % per_shard * stride(sequence))
           .select("slot", "shard", "offset", "doc_id", "piece", "n_ids", "crc32", "record"))
    # The slots are a permutation of 0..n-1, so equal ranges of them hold equally many rows.
    shards = max(1, -(-n // per_shard))
    return out.repartitionByRange(shards, "slot").sortWithinPartitions("slot")


def materialise(documents: DataFrame, path: str, key: int = KEY, sequence: int = SEQUENCE, per_shard: int = PER_SHARD,
                vocabulary: str = VOCABULARY) -> int:
    """Write the shards that ``path`` does not hold yet; how many. A call after one that was stopped goes on with its numbering."""
    spark, held = documents.sparkSession, f"{path.rstrip('/')}/_records"
    if "_SUCCESS" not in files.names(spark, held):  # written last, when all tasks are done
        records(documents, sequence, vocabulary).write.mode("overwrite").parquet(held)
        if "_SUCCESS" not in files.names(spark, held):
            files.touch(spark, f"{held}/_SUCCESS")
    return write_shards(in_order(spark.read.schema(RECORDS).parquet(held), key, sequence, per_shard), path)


def write_shards(order: DataFrame, path: str) -> int:
    """Write the shards that ``path`` does not hold yet, a folder with one file of records each; how many it wrote.

    A shard's file appears whole when the job commits, so a stopped run leaves whole shards or none.
    """
    spark = order.sparkSession
    there = {int(n.split("=")[1]) for n in files.names(spark, path) if n.startswith("shard=")}
    missing = order.where(~F.col("shard").isin(sorted(there))) if there else order
    n = missing.select("shard").distinct().count()
    if n:  # the bytes of a record are written as they are, and the line feed
        (missing.repartitionByRange("shard").sortWithinPartitions("shard", "slot").select("shard", F.col("record").cast("string").alias("value"))
         .write.mode("append").option("lineSep", "\n").option("maxRecordsPerFile", 0).partitionBy("shard").text(path))
    return n


def read_from(spark, path: str, slot: int, per_shard: int = PER_SHARD, sequence: int = SEQUENCE, at_once: int = 1024) -> Iterator[np.ndarray]:
    """Ids of the sequences from ``slot`` on, shard after shard: what a resumed training run reads. Seeks to the slot's
    place in its shard's file and reads on, ``at_once`` records at a time."""
    jvm, width = spark._jvm, stride(sequence)
    while True:
        shard = f"{path.rstrip('/')}/shard={slot // per_shard}"
        parts = [n for n in files.names(spark, shard) if not n.startswith(("_", "."))]
        if not parts:
            return
        place = jvm.org.apache.hadoop.fs.Path(f"{shard}/{parts[0]}")
        fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
        size, at = fs.getFileStatus(place).getLen(), slot % per_shard * width
        stream = fs.open(place)
        try:
            while at < size:
                stream.seek(at)
                data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(at_once * width, size - at)))
                for i in range(0, len(data), width):
                    yield np.frombuffer(data[i:i + 2 * sequence], dtype="<u2")
                at += len(data)
        finally:
            stream.close()
        slot += per_shard - slot % per_shard
