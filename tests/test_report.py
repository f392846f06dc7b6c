"""The report of tables that are longer than it shows."""

from __future__ import annotations

from bookflow.sources import sinks


def test_markdown_orders_a_cut_table_and_says_so(spark):
    text = sinks.to_markdown("r", {"long": spark.range(300, 0, -1).repartition(4), "short": spark.range(2)})
    long, short = text.split("## short")
    assert [line for line in long.splitlines() if line.startswith("| ")][1:] == [f"| {k} |" for k in range(1, 201)]
    assert "200 of 300 rows, see CSV" in long and "see CSV" not in short
