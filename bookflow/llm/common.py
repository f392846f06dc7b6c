"""Shared plumbing of the training-data operators: scratch storage and typed column access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.runtime import clear, home, remove, scratch

__all__ = ["clear", "folders", "home", "materialize", "remove", "scratch", "table", "text_or_empty"]


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where it doesn't exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def materialize(df: DataFrame, label: str, **options: str | int) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in shared scratch space and read it back: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
