"""Order-book views over the driver's tables: an idealised book over ``lineitem`` and model scores over the same rows.

Everything here is local to a row, so any engine gives bit-equal values. The order of ticks is made explicit as ``row_nr``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey"
BID, ASK = "(l_extendedprice * (1 - l_discount) / 100000)", "(l_extendedprice * (1 + l_tax) / 100000)"
MID = f"(({BID} + {ASK}) / 2)"


def book_columns(long: bool, centred: bool = False) -> list[str]:
    """``long``: one group for each instrument; else groups are instrument, year and half of the year."""
    less = " - 0.5" if centred else ""
    key = ["l_suppkey AS sym", "0 AS date", "0 AS session"] if long else ["l_suppkey AS sym", "CAST(year(l_shipdate) AS INT) AS date", "CASE WHEN month(l_shipdate) <= 6 THEN 0 ELSE 1 END AS session"]
    prices = [f"{BID}{less} - 0.0001 * {i - 1} AS n_bid{i}" for i in range(1, 6)] + [f"{ASK}{less} + 0.0001 * {i - 1} AS n_ask{i}" for i in range(1, 6)]
    sizes = [f"l_quantity * {i} AS n_bsize{i}" for i in range(1, 6)] + [f"CAST((l_partkey * {i}) % 50 + 1 AS DOUBLE) AS n_asize{i}" for i in range(1, 6)]
    return [
        *key,
        *prices,
        *sizes,
        f"{MID}{less} AS n_midprice",
        f"({MID} - 0.5) / 5 AS n_close",
        "l_extendedprice AS amount_delta",
        "CAST((l_orderkey * 3) % 86400 AS INT) AS tod",
        "l_returnflag AS flag",
        *(c for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")),
    ]


NUMBERED = f"CAST(row_number() OVER (PARTITION BY sym, date, session ORDER BY {ORDER}) AS INT) AS row_nr"


#: What a book is made from. These columns travel to a group's task, and the wider book is made from them there.
LINE = [f"l_{c}" for c in ("suppkey", "shipdate", "orderkey", "linenumber", "partkey", "extendedprice", "discount", "tax", "quantity", "returnflag")]


def book(spark: SparkSession, sf_dir: str, long: bool = False, centred: bool = False, ranged: bool = False) -> DataFrame:
    """Ticks of all groups; ``ranged``: groups are dealt by ranges, so that an instrument's groups are in one task or two."""
    key, made = book_columns(long, centred)[:3], book_columns(long, centred)[3:]
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*key, *LINE)
    lines = lines.repartitionByRange("sym", "date", "session") if ranged else lines
    return lines.selectExpr("*", NUMBERED).selectExpr("sym", "date", "session", *made, "row_nr")


def book_ctes(long: bool = False, centred: bool = False) -> list[str]:
    return [f"book0 AS (SELECT {', '.join(book_columns(long, centred))} FROM lineitem)", f"book AS (SELECT *, {NUMBERED} FROM book0)"]


SCORES = [
    "l_suppkey AS sym",
    "CAST(year(l_shipdate) AS INT) AS date",
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_shipdate",
    "CAST(l_discount * 100 AS DOUBLE) / 10 AS p2",
    "(1 - l_discount * 10) * l_tax * 12.5 AS p0",
    "CAST((l_linenumber + l_orderkey) % 3 AS INT) AS y_true",
    "CAST((l_orderkey + l_partkey) % 5 AS INT) AS horizon_nr",
    "(l_tax - l_discount) / 100 AS price_diff",
]
#: Rounded to four places, so that every engine thresholds and compares the same numbers.
SCORED = ["*", "round(p2, 4) AS up", "round(p0, 4) AS down", "round(1 - p0 - p2, 4) AS flat"]


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*SCORES).selectExpr(*SCORED)


SCORE_CTES = [f"scores0 AS (SELECT {', '.join(SCORES)} FROM lineitem)", f"scores AS (SELECT {', '.join(SCORED)} FROM scores0)"]
