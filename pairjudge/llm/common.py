"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pairjudge.session import checkpoint_dir

#: Bytes of text that a Python stage works on at a time.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage: what follows survives lost executors without repeating the work, and reads
    the same rows in the same order each time. The session removes a private scratch folder when
    it ends; a shared one is the cluster's to expire.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(),
          "binary": T.BinaryType(), "array<long>": T.ArrayType(T.LongType())}


def struct(fields: str) -> T.StructType:
    """Schema of ``name type, ...``, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(","))])


class Scratch:
    """Tables in a scratch folder of their own, removed at the end of the ``with`` block that what is kept is written in."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.path = spark, f"{checkpoint_dir(spark).rstrip('/')}/llm/{tag}-{uuid.uuid4().hex[:12]}"

    def __enter__(self) -> Scratch:
        return self

    def written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def strings(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


def out_batch(schema: T.StructType, columns: dict[str, list]) -> pa.RecordBatch:
    """Arrow batch of the given Python columns, typed as ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)


def pack(values: np.ndarray) -> bytes:
    """An array as bytes of equal weight together, so that zstd meets the empty high ones in a row."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def text_digest(text: Column) -> Column:
    """128-bit hash that, with the doc_id, tells rows apart that are not copies; null for null."""
    return F.md5(text.cast("string").cast("binary"))


def packed(documents: DataFrame) -> DataFrame:
    """``row`` (all columns of a document, as a struct, so that no name of theirs meets another), ``id`` and ``digest`` of its text."""
    return documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
                            F.col("doc_id").alias("id"), text_digest(F.col("text")).alias("digest"))


def unpacked(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """The columns of ``documents`` from ``row``."""
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches so that each holds about ``limit`` bytes of text (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def dense_rank(df: DataFrame, order: list[str], group: list[str], rank: str) -> DataFrame:
    """Add ``rank``: 0, 1, 2, ... within each ``group``, gapless, without sorting a group in one task.

    Rows are spread over about sqrt(rows) hash buckets of their ``order`` columns; ranks inside a
    bucket come from a window, and the start of each bucket from a running sum over the bucket counts. ``order`` must
    tell rows apart, or the rows it does not tell apart must be interchangeable. ``df`` is read
    twice, so it should be a written table.
    """
    n = df.count()
    buckets = max(1, math.isqrt(n))
    keyed = df.withColumn("__bucket", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    # sqrt(rows) rows per group at most.
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*group, "__bucket").orderBy(*order)
    ranked = keyed.withColumn("__in", F.row_number().over(inside) - 1)
    return (ranked.join(starts, [*group, "__bucket"])
            .withColumn(rank, (F.col("__start") + F.col("__in")).cast("long"))
            .drop("__start", "__in", "__bucket"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
