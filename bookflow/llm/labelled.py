"""Labelled rows for the classifiers: the hold-out rule and a bounded training sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import materialize

#: Labelled rows that a classifier is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE_ROWS = 12_000


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of the rows whose labels are never learned from: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, rows: int | None = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """(label, text) of at most ``rows`` labelled documents (None: all) that aren't held out, and the folder that holds them.

    The ids that are sent to all executors are bounded by ``rows``; all rows are joined as Spark sees fit. Of several labels of one id the largest counts, of several
    texts the greatest; labels other than 0 and 1 don't.
    """
    picked = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(target).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    if rows is not None:
        picked = F.broadcast(picked.orderBy(F.xxhash64("id"), "id").limit(rows))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return materialize(texts.join(picked, "id").groupBy("id", "label").agg(F.max("text").alias("text")), "labelled")
