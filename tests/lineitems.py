"""Made ``lineitem`` tables for the book and score views."""

from __future__ import annotations

import datetime as dt

COLUMNS = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate date"


def ticks(prices: list[float], sym: int, year: int = 1994, sizes: list[float] | None = None, first_key: int = 1) -> list[tuple]:
    """Rows of one instrument in half a year, in the book's order, with bid = ask = mid = the given prices."""
    sizes = sizes or [1.0] * len(prices)
    return [(first_key + k, 0, sym, 1, size, price * 100000, 0.0, 0.0, "N", dt.date(year, 2, 1)) for k, (price, size) in enumerate(zip(prices, sizes))]


def write(spark, folder, rows: list[tuple]) -> str:
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)
