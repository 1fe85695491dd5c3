"""Folders and marks on the file system that Spark reads and writes (any Hadoop one)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it is not there."""
    fs, place = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether a folder, or one below it, holds a file that readers see (names with _ or . are hidden)."""
    fs, place = _at(spark, path)
    return fs.exists(place) and _visible_file(fs, place)


def _visible_file(fs, place) -> bool:
    inside = [s for s in fs.listStatus(place) if not s.getPath().getName().startswith(("_", "."))]
    return any(s.isFile() for s in inside) or any(_visible_file(fs, s.getPath()) for s in inside if s.isDirectory())


def touch(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.create(place, True).close()


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder; the folders above the new place are made, the place itself must be free."""
    fs, place = _at(spark, path)
    target = _at(spark, to)[1]
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(place, target):
        raise OSError(f"cannot move {path} to {to}")


def partition_folder(spark: SparkSession, values: dict) -> str:
    """``a=1/b=2``, with Spark's escapes, as a partitioned writer names the folder of these values."""
    utils = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return "/".join(utils.getPartitionPathString(c, None if v is None else str(v)) for c, v in values.items())
