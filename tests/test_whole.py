"""Queries over small made tables whose whole result is known by hand."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from bookflow.operators import evaluate
from bookflow.registry import QUERIES
from bookflow.schema import HORIZONS
from tests import lineitems


def test_file_completeness_sees_every_order(spark, tmp_path):
    rows = [(k, status, priority, dt.date(year, 3, 1)) for k, (status, priority, year) in enumerate([("F", "1-URGENT", 1992), ("F", "1-URGENT", 1993), ("O", "5-LOW", 1998), ("O", "1-URGENT", 1995)], 1)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_orderpriority string, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    found = {tuple(r) for r in QUERIES["file_completeness"](spark, str(tmp_path)).collect()}
    seen = {(status, priority, date.year) for _, status, priority, date in rows}
    every = {(s, p, y) for s in "FO" for p in ("1-URGENT", "5-LOW") for y in range(1992, 2000)}
    assert found == every - seen


def test_signal_rows_has_every_endpoint_and_horizon(spark, tmp_path):
    prices = [((k * 37) % 101) / 100 + 1 for k in range(166)]
    found = QUERIES["signal_rows"](spark, lineitems.write(spark, tmp_path, lineitems.ticks(prices, sym=7))).collect()
    assert sorted((r.row_nr, r.horizon) for r in found) == [(k + 1, h) for k in range(99, 106) for h in HORIZONS]
    for r in found:
        entry, exit_ = prices[r.row_nr - 1], prices[r.row_nr - 1 + r.horizon]
        side = {0: -1, 1: 1, 2: 0}[r.row_nr % 3]
        assert (float(r.entry_mid), float(r.exit_mid), float(r.price_diff), float(r.pnl)) == pytest.approx((entry, exit_, exit_ - entry, side * (exit_ - entry)), abs=1e-4)


def test_batch_predict_fits_each_horizon_to_its_own_move(spark, tmp_path):
    """One odd instrument whose price swings with a period of 20 ticks, the phase told by its sizes: moves of 5 and 10 ticks
    differ in sign, those of 20, 40 and 60 are none."""
    swing = [abs(k % 20 - 10) / 10 + 1 for k in range(400)]
    phase = [float(k % 20 + 1) for k in range(400)]
    rows = [*lineitems.ticks(swing, 7, 1994, phase), *lineitems.ticks(swing, 7, 1997, phase, 1000)]
    found = QUERIES["batch_predict"](spark, lineitems.write(spark, tmp_path, rows)).collect()
    assert {(r.sym, r.date, r.row_nr) for r in found} == {(7, year, k + 1) for year in (1994, 1997) for k in range(400)}
    later = {r.row_nr - 1: r for r in found if r.date == 1997}
    right = {}
    for h in HORIZONS:
        moves = {k: round(swing[k + h] - swing[k], 6) for k in range(400 - h)}
        right[h] = sum(later[k][f"signal_{h}"] == (0 if m < 0 else 2 if m > 0 else 1) for k, m in moves.items()) / len(moves)
    assert min(right.values()) > 0.85, right


def test_ratio_queries_search_all_pairs(spark, tmp_path):
    """Each measure of all 676 pairs against loops over the rows, some of which occur more than once."""
    draw = random.Random(33)
    rows = [(k, 0, 1, 1, 1.0, 1.0, draw.randrange(0, 11) / 100, draw.randrange(0, 9) / 100, "N", dt.date(1994, 2, 1)) for k in range(40)]
    rows += [(row[0] + 300, *row[1:]) for row in rows[:10]]
    folder = lineitems.write(spark, tmp_path, rows)
    scored = []
    for key, *_, discount, tax, _, _ in rows:
        p2, p0 = discount * 100 / 10, (1 - discount * 10) * tax * 12.5
        scored.append((round(p0, 4), round(1 - p0 - p2, 4), round(p2, 4), (1 + key) % 3, (tax - discount) / 100))
    expected = {}
    for a in evaluate.ratio_values():
        for b in evaluate.ratio_values():
            called = [(0 if d * a >= f and d * a >= u * b else 1 if f >= u * b else 2, y, c) for d, f, u, y, c in scored]
            trades, right = sum(s != 1 for s, _, _ in called), sum(s != 1 and s == y for s, y, _ in called)
            precision, recall = right / max(trades, 1), right / max(sum(y != 1 for _, y, _ in called), 1)
            pnl = sum(c if s == 2 else -c if s == 0 else 0.0 for s, _, c in called)
            expected[a, b] = (len(called), trades, right, pnl, 1.25 * precision * recall / (0.25 * precision + recall + 1e-10))
    grid = {(r.down_ratio, r.up_ratio): r for r in QUERIES["ratio_grid"](spark, folder).collect()}
    assert len(expected) == 676 and grid.keys() == expected.keys()
    for pair, (n, trades, right, pnl, f05) in expected.items():
        r = grid[pair]
        assert (r.n, r.trades, r.correct) == (n, trades, right)
        assert (r.total_pnl, r.f05) == pytest.approx((pnl, f05), abs=1e-5)
    best = min(expected, key=lambda pair: (-round(expected[pair][4], 9), pair))
    assert not {round(x * 10, 6) for x in best} <= set(range(5, 11))
    assert [tuple(r) for r in QUERIES["ratio_best"](spark, folder).collect()] == [(*best, expected[best][1])]
    assert [tuple(r) for r in QUERIES["ratio_grid_full"](spark, folder).collect()] == sorted(((*pair, v[1]) for pair, v in expected.items()), key=lambda r: (-r[2], r[:2]))
