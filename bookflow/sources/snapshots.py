"""Snapshot files: catalogue, tolerant reading, ingestion. A file is one instrument, day and session."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookflow.functions.exprs import known
from bookflow.schema import LABELS, RAW, SNAPSHOT

#: Fixed value: the name of a snapshot file.
NAME = r"snapshot_sym(\d+)_date(\d+)_(am|pm)\.csv$"
#: A comma outside quotes, and a quoted cell.
COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'
QUOTED = '^"(.*)"$'


def parsed(path: Column) -> list[Column]:
    """(source_file, sym_id, date_id, session, session_nr): NULL where the name isn't a snapshot's."""
    file = F.element_at(F.split(path, "/"), -1)
    part = lambda k: F.nullif(F.regexp_extract(file, NAME, k), F.lit(""))
    return [file.alias("source_file"), part(1).try_cast("int").alias("sym_id"), part(2).try_cast("int").alias("date_id"), part(3).alias("session"), F.when(part(3) == "am", 0).when(part(3) == "pm", 1).alias("session_nr")]


def parsed_or_zero(path: Column) -> list[Column]:
    """The older form: what can't be read is 0."""
    _, sym, date, _, session = parsed(path)
    return [F.coalesce(sym, F.lit(0)).alias("sym_id"), F.coalesce(date, F.lit(0)).alias("date_id"), F.coalesce(session, F.lit(0)).alias("session_nr")]


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of every CSV file under a folder, empty ones too, from the file system's own listing."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True)
    found = []
    while files.hasNext():
        f = files.next()
        if (path := f.getPath().toString()).endswith(".csv"):
            found.append((path, f.getLen()))
    return spark.createDataFrame(found, "path string, length long")


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each CSV file, without reading contents; order: date, session, instrument."""
    return listed(spark, folder).select("path", "length", *parsed(F.col("path"))).orderBy("date_id", "session", "sym_id", "source_file")


def select_files(files: DataFrame, sym: int | None = None, first_date: int | None = None, last_date: int | None = None, session: str | None = None, most: int | None = None) -> DataFrame:
    """Filters on what file names say, both dates included; ``most`` keeps the first files in order."""
    for given, condition in ((sym, F.col("sym_id") == sym), (first_date, F.col("date_id") >= first_date), (last_date, F.col("date_id") <= last_date), (session, F.col("session") == session)):
        files = files if given is None else files.filter(condition)
    files = files.filter("sym_id IS NOT NULL")
    return files if most is None else files.orderBy("date_id", "session", "sym_id").limit(most)


def unexpected(files: DataFrame, syms: int = 10, dates: int = 79) -> DataFrame:
    """Files whose name can't be read, or that lie outside the expected range."""
    reason = F.when(F.col("sym_id").isNull(), "parse_failure").when(~F.col("sym_id").between(0, syms - 1) | ~F.col("date_id").between(0, dates - 1), "out_of_range")
    return files.withColumn("reason", reason).filter("reason IS NOT NULL").select("source_file", "sym_id", "date_id", "session", "reason")


def missing(files: DataFrame, syms: int = 10, dates: int = 79) -> DataFrame:
    """Expected combinations without a file: 10 instruments, 79 days and 2 sessions by default."""
    spark = files.sparkSession
    expected = spark.range(syms).select(F.col("id").cast("int").alias("sym_id")).crossJoin(spark.range(dates).select(F.col("id").cast("int").alias("date_id"))).crossJoin(spark.createDataFrame([("am",), ("pm",)], "session string"))
    gone = expected.join(files.select("sym_id", "date_id", "session").distinct(), ["sym_id", "date_id", "session"], "left_anti")
    return gone.withColumn("expected_file_name", F.format_string("snapshot_sym%d_date%d_%s.csv", "sym_id", "date_id", "session"))


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(path, row, line) of every line that isn't empty, counted from 0 in its file, and (path, line) of the first ones.

    Files are read in splits by many tasks. A task counts a split's lines as they come; what the splits before it hold is a sum
    over one row a split. No line is shuffled or waits for its file's other lines.
    """
    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.rtrim(F.col("value"), F.lit("\r")).alias("line")).filter("line <> ''")

    def count(batches):
        last, n = None, 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            paths_, blocks = batch.column(0), batch.column(1)
            new = np.ones(rows, bool)
            new[1:] = ~pc.and_(pc.equal(paths_[1:], paths_[:-1]), pc.equal(blocks[1:], blocks[:-1])).to_numpy(zero_copy_only=False)
            first = (paths_[0].as_py(), blocks[0].as_py())
            if first == last:  # the split goes on from the batch before
                new[0] = False
            at = np.flatnonzero(new)
            begin = np.zeros(rows, np.int64)
            begin[at] = at
            begin = np.maximum.accumulate(begin)
            place = np.arange(rows) - begin + np.where(np.cumsum(new) == 0, n, 0)
            last, n = (paths_[rows - 1].as_py(), blocks[rows - 1].as_py()), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([paths_, blocks, pa.array(place), batch.column(2)], names=["path", "block", "place", "line"])

    lines = text.mapInArrow(count, "path string, block long, place long, line string")
    splits = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("held"), F.min_by("line", "place").alias("first"))
    order = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("path", "block", "first", F.coalesce(F.sum("held").over(order), F.lit(0)).alias("before"))
    found = lines.join(before.drop("first"), ["path", "block"]).select("path", (F.col("before") + F.col("place")).alias("row"), "line")
    return found, before.filter("before = 0").select("path", F.col("first").alias("line"))


def cells(line: Column) -> Column:
    """A line's cells, without white space and quotes around them; a comma inside quotes doesn't part cells."""
    quoted = F.split(line, COMMA)
    plain = F.split(line, ",")
    bare = lambda c: F.trim(c)
    whole = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), QUOTED, "$1"), '""', '"')
    return F.when(line.contains('"'), F.transform(quoted, whole)).otherwise(F.transform(plain, bare))


def heads(first: DataFrame) -> DataFrame:
    """(path, head): the names in files' first lines; ``label5`` is read as ``label_5``."""
    return first.select("path", F.transform(cells(F.col("line")), lambda c: F.regexp_replace(c, r"^label(\d+)$", "label_$1")).alias("head"))


def read(spark: SparkSession, paths: str | list[str], schema: T.StructType = SNAPSHOT) -> DataFrame:
    """Rows of snapshot files by column name, tagged with their file, in file order (``row_nr``), however large a file is.

    Columns are matched by each file's header, absent ones are NULL; malformed numbers and NaN become NULL.
    """
    names = [f.name for f in schema.fields]
    lines, first = numbered_lines(spark, paths)
    rows = lines.filter("row > 0").join(heads(first), "path").select("path", "head", F.col("row").cast("int").alias("row_nr"), cells(F.col("line")).alias("cells"))
    cell = lambda n: F.get("cells", F.array_position("head", n).cast("int") - 1)
    values = rows.select(*parsed(F.col("path")), "row_nr", *(F.when(F.array_contains("head", n), F.nullif(cell(n), F.lit(""))).alias(n) for n in names))
    return typed(values, schema)


def typed(values: DataFrame, schema: T.StructType) -> DataFrame:
    """Cells of ``schema`` as numbers, with their file's tags; what can't be read is NULL, a missing day or instrument 0."""
    names = [f.name for f in schema.fields]
    rows = values.select("source_file", "sym_id", "date_id", F.col("session").alias("session_name"), F.col("session_nr").alias("session"), "row_nr", *(F.expr(known(n)).alias(n) if f.dataType == T.DoubleType() else F.expr(f"try_cast({n} AS {f.dataType.simpleString()})").alias(n) for n, f in zip(names, schema.fields)))
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("date", "sym") if c in names})


def sample_columns(spark: SparkSession, folder: str, rows: int = 400) -> list[str]:
    """The columns that the first ``rows`` rows of the first file, in order, have values in."""
    first = catalogue(spark, folder).filter("sym_id IS NOT NULL AND length > 0").limit(1).collect()
    if not first:
        raise ValueError(f"no snapshot files in {folder}")
    names = [f.name for f in SNAPSHOT.fields]
    head = read(spark, first[0]["path"]).filter(F.col("row_nr") <= rows).agg(*(F.count(n).alias(n) for n in names)).first()
    return [n for n in names if head[n]]


def read_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Rows read from each file; an empty file has 0."""
    files = catalogue(spark, folder).select("path", "source_file", "length")
    counts = read(spark, folder).groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))
    return files.join(counts, "source_file", "left").select("source_file", F.coalesce("rows", F.lit(0)).alias("rows"), F.when(F.coalesce("rows", F.lit(0)) == 0, "empty").otherwise("ok").alias("status"))


def field_completeness(spark: SparkSession, folder: str, expected: list[str]) -> DataFrame:
    """By file: expected columns that its header lacks, and columns beyond them."""
    head = numbered_lines(spark, folder)[1].select(*parsed(F.col("path"))[:1], cells(F.col("line")).alias("head"))
    wanted = F.array(*(F.lit(c) for c in expected))
    return head.select("source_file", F.array_except(wanted, "head").alias("missing"), F.array_except("head", wanted).alias("extra"))


def field_groups() -> dict[str, list[str]]:
    return {"prices": [c for c in RAW if "bid" in c or "ask" in c], "volume": ["amount_delta"], "mid": ["n_midprice"], "labels": LABELS}


def missing_field_groups(df: DataFrame) -> list[str]:
    """Which groups of columns a table lacks altogether."""
    return [g for g, columns in field_groups().items() if not set(columns) & set(df.columns)]


def missing_field_groups_by_file(spark: SparkSession, folder: str) -> DataFrame:
    """The same by file, from its header; an empty file lacks all of them."""
    head = heads(numbered_lines(spark, folder)[1]).select(*parsed(F.col("path"))[:1], "head")
    lacking = [F.when(~F.arrays_overlap("head", F.array(*(F.lit(c) for c in columns))), g) for g, columns in field_groups().items()]
    found = head.select("source_file", F.array_compact(F.array(*lacking)).alias("missing_groups"))
    empty = catalogue(spark, folder).filter("length = 0").select("source_file", F.array(*(F.lit(g) for g in field_groups())).alias("missing_groups"))
    return found.join(empty, "source_file", "left_anti").unionByName(empty)


def ingest(spark: SparkSession, folder: str, path: str, partitions: int | None = None) -> DataFrame:
    """Snapshot files to Parquet, one folder for each day, each instrument's session together and in order.

    Later window stages sort what is nearly sorted, and filters on days prune folders.
    """
    rows = read(spark, folder)
    keyed = rows.repartition(*([partitions] if partitions else []), "date_id", "session", "sym_id").sortWithinPartitions("date_id", "session", "sym_id", "time", "row_nr")
    keyed.write.mode("overwrite").partitionBy("date_id").parquet(path)
    return spark.read.parquet(path)


def ticks(rows: DataFrame) -> DataFrame:
    """Ingested rows as ticks: key columns named as windows expect, order by time then file order."""
    ordered = rows.selectExpr("* EXCEPT (row_nr)", "row_nr AS file_row")
    return ordered.selectExpr("*", "CAST(row_number() OVER (PARTITION BY sym, date, session ORDER BY time, file_row) AS INT) AS row_nr")


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Signal rows written before: bad numbers are 0, ``correct`` is true for 1, true and yes."""
    raw = spark.read.option("header", "true").csv(path)
    number = lambda c, kind: F.coalesce(F.col(c).try_cast(kind), F.lit(0).cast(kind)).alias(c)
    kinds = {"sym": "int", "date": "int", "row_idx": "int", "horizon": "int", "pred": "int", "actual": "int", "entry_mid": "double", "exit_mid": "double", "price_diff": "double", "pnl": "double"}
    return raw.select(*(number(c, kinds[c]) if c in kinds else F.lower("correct").isin("1", "true", "yes").alias(c) if c == "correct" else F.col(c) for c in raw.columns))


