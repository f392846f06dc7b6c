"""Writers of features, samples, reports and small results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def write_features(df: DataFrame, path: str, by: str = "date") -> int:
    """Partitioned Parquet; the row count is read back from the files' footers."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)
    return df.sparkSession.read.parquet(path).count()


def write_samples(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> DataFrame:
    """Training samples by split and label; readers of labels and moves read those columns alone."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("split", "label").parquet(path)
    return df.sparkSession.read.parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write ended: its marker is there."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def to_json(df: DataFrame, most: int = 10_000) -> str:
    """A small result (settings, metrics) as JSON text; more than ``most`` rows is an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them with Spark")
    return json.dumps([r.asDict(recursive=True) for r in rows], default=str)


def to_markdown(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """A report of small tables; of one with more than ``most`` rows the first in the columns' order, which is said below it."""
    out = [f"# {title}"]
    for name, df in tables.items():
        total = df.count()
        rows = (df if total <= most else df.orderBy(*df.columns).limit(most)).collect()
        out += [f"\n## {name}\n", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
        out += [f"\n{len(rows)} of {total} rows, see CSV"] if total > most else []
    return "\n".join(out) + "\n"


def remove_with_counts(spark: SparkSession, path: str) -> tuple[int, int]:
    """Delete a folder; (files, bytes) that it held."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return 0, 0
    summary = fs.getContentSummary(p)
    counts = summary.getFileCount(), summary.getLength()
    fs.delete(p, True)
    return counts
