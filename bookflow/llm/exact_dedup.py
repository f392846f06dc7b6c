"""Exact dedup against a persistent digest index, with DataFrame operators only.

The index is two tables, bucketed and sorted by the digest of the text: ``digests`` (digest, keep_id), a row for each
digest, and ``counts`` (digest, batch, last_id, rows), a row for each digest and appended batch. New rows are reduced to one
row per digest before any shuffle (so a text that makes up a third of all rows is one row per task) and appended to
``counts``; those rows meet ``digests`` in a sort-merge anti-join, and what is new is appended there: a digest keeps the id
that came first. All tables are bucketed alike, so the index itself is never shuffled.

A one-off dedup is the same work on a new index: ids are appended in slices from the largest down, so the first id of each
digest is its largest. The index can be closed, opened again by its path in another session or without a metastore, and
appended to; nothing ever overwrites it. A batch that is appended twice under one name (a retry) counts once.

Defined results: a null text counts as empty; empty texts equal each other; repeated (id, text) rows each count in
``group_size`` and share one ``keep_id``; a null id never wins over a known one in its batch; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.llm.common import folders, materialize, remove, scratch, text_or_empty

DIGEST = "text_sha256"
#: A digest is hot with more than one in HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot ones.
HOT_SHARE = 1000
#: Slices of falling ids in which a one-off dedup appends.
SLICES = 2
#: Stands for a null id inside the index: smaller than any id, so a known id wins.
NO_ID = -(2**63)
TABLES = {"digests": "digest BINARY, keep_id BIGINT", "counts": "digest BINARY, batch STRING, last_id BIGINT, rows BIGINT"}


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, 32-byte digest) of every row; texts are never shuffled."""
    return docs.select(_id(id_col).alias("id"), _digest(text_col).alias("digest"))


def _id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256))


class DigestIndex:
    """The tables of an index under ``path``, opened or made.

    The number of buckets is part of the folders' names, so an index is read as it was written whatever the session's
    settings are.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or scratch(spark, "digest-index")
        found = {int(name.rsplit("_", 1)[1]) for name in folders(spark, self.path) if name.rsplit("_", 1)[0] in TABLES}
        self.buckets = found.pop() if found else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        tag = uuid.uuid4().hex
        self.names = {name: f"{name}_{tag}" for name in TABLES}
        for name, columns in TABLES.items():
            spark.sql(f"CREATE TABLE {self.names[name]} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}_{self.buckets}'")

    def close(self) -> None:
        """Forget the session's names of the tables; the files stay."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.names[name])

    def read(self) -> DataFrame:
        """(digest, keep_id, group_size)."""
        counts = self.table("counts").groupBy("digest").agg(F.sum("rows").alias("group_size"))
        return self.table("digests").join(counts.hint("merge"), "digest")

    def _add(self, rows: DataFrame, name: str, dealt: bool = True) -> None:
        """Append; rows that aren't dealt by bucket yet are, so that a task writes few buckets."""
        if not dealt and int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            rows = rows.repartition(self.buckets, "digest")
        rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.names[name])
        self.spark.catalog.refreshTable(self.names[name])

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> None:
        """Add the digests of ``docs`` that the index doesn't have yet, and count all rows."""
        self.append_rows(digests(docs, id_col, text_col), batch)

    def append_rows(self, rows: DataFrame, batch: str | None = None) -> None:
        """As ``append``, from (id, digest) rows. A batch that failed half way is completed under the same name."""
        label = batch or uuid.uuid4().hex
        if batch is None or self.table("counts").filter(F.col("batch") == batch).isEmpty():
            found = rows.groupBy("digest").agg(F.max("id").alias("last_id"), F.count(F.lit(1)).alias("rows"))
            self._add(found.select("digest", F.lit(label).alias("batch"), "last_id", "rows"), "counts", dealt=False)
        added = self.table("counts").filter(F.col("batch") == label).select("digest", F.col("last_id").alias("keep_id"))
        self._add(added.join(self.table("digests").select("digest").hint("merge"), "digest", "left_anti"), "digests")


def one_off(rows: DataFrame, slices: int = SLICES) -> DigestIndex:
    """A new index of (id, digest) rows, appended in slices of falling ids."""
    index = DigestIndex(rows.sparkSession)
    cuts = rows.agg(F.percentile_approx("id", [k / slices for k in range(slices - 1, 0, -1)])).first()[0] or []
    upper = None
    for cut in [*dict.fromkeys(cuts), None]:
        part = rows if cut is None else rows.filter(F.col("id") >= cut)
        index.append_rows(part if upper is None else part.filter(F.col("id") < upper))
        upper = cut
    return index


def assign(rows: DataFrame, index: DigestIndex, id_col: str = "doc_id") -> DataFrame:
    """Every (id, digest) row with the group it belongs to; the index must hold its digest.

    Digests of more than a thousandth of these rows are fewer than a thousand: they are broadcast, and their rows don't
    move. All other rows meet the index in a sort-merge join that no digest can weigh down.
    """
    known = index.read()
    total = rows.count()
    often = F.broadcast(rows.groupBy("digest").count().filter(F.col("count") > total / HOT_SHARE).select("digest"))
    hot, rest = known.join(often, "digest"), rows.join(often, "digest", "left_anti")
    found = rows.join(F.broadcast(hot), "digest").unionByName(rest.join(known.hint("merge"), "digest"))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(back("id").alias(id_col), back("keep_id").alias("keep_id"), "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias(DIGEST))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows, _ = materialize(digests(docs, id_col, text_col), "digests")
    return assign(rows, one_off(rows), id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows repeated with id and text, one stays.

    The join key is (digest, id): ids spread a hot digest over all tasks, and the final distinct reuses that exchange.
    """
    rows, path = materialize(digests(docs, id_col, text_col), "digests")
    index = one_off(rows)
    remove(docs.sparkSession, path)
    tag = uuid.uuid4().hex[:8]
    keys = [f"digest_{tag}", f"id_{tag}"]
    stay = index.table("digests").select(F.col("digest").alias(keys[0]), F.col("keep_id").alias(keys[1]))
    return docs.withColumns({keys[0]: _digest(text_col), keys[1]: _id(id_col)}).join(stay.hint("merge"), keys, "left_semi").dropDuplicates(keys).drop(*keys)
