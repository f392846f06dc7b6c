"""Exact and near duplicates, components and shingles against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bookflow.llm import exact_dedup, near_dup, shingles
from bookflow.llm.components import connected_components
from tests.llm.helpers import ROWS, components, documents, empty, shingle_set


def test_exact(spark):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.dedup(documents(spark)).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    groups = {}
    for d, t, *_ in ROWS:
        groups.setdefault(sha(t), []).append(d)
    assert len(got) == len(ROWS) - 1  # one row is repeated
    for (doc_id, digest), r in got.items():
        keep = max((d for d in groups[digest] if d is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(groups[digest]), doc_id == keep)
    assert exact_dedup.dedup(documents(spark)).count() == len(ROWS)
    assert exact_dedup.dedup(empty(spark)).count() == 0


def test_exact_keeps_one_whole_row(spark):
    kept = exact_dedup.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 14, 15]
    assert exact_dedup.keep_one(empty(spark)).count() == 0


def test_index_grows_and_counts(spark):
    """Three appends; counts equal SQL over all rows, kept ids are those of the first batch that had the text."""
    index = exact_dedup.DigestIndex(spark)
    parts = [ROWS[:4], ROWS[2:9], ROWS[5:]]
    for part in parts:
        index.append(documents(spark, part))
    sha = lambda t: hashlib.sha256((t or "").encode()).digest()
    size, first = {}, {}
    for part in parts:
        largest = {}
        for d, t, *_ in part:
            size[sha(t)] = size.get(sha(t), 0) + 1
            largest[sha(t)] = max(largest.get(sha(t), exact_dedup.NO_ID), exact_dedup.NO_ID if d is None else d)
        first = largest | first
    got = index.read().collect()
    assert {bytes(r.digest): r.group_size for r in got} == size and {bytes(r.digest): r.keep_id for r in got} == first


def test_index_survives_a_restart(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    index.append(documents(spark, ROWS[:4]))
    index.close()  # as a session without the catalogue's entries
    again = exact_dedup.DigestIndex(spark, index.path, buckets=7)
    assert again.buckets == 3
    before = {bytes(r.digest): (r.keep_id, r.group_size) for r in again.read().collect()}
    assert len(before) == 3
    again.append(documents(spark, [(9, ROWS[0][1], "en", "a", 0), (20, "new", "en", "a", 0)]), batch="today")
    again.append(documents(spark, [(9, ROWS[0][1], "en", "a", 0), (20, "new", "en", "a", 0)]), batch="today")  # a retry
    after = {bytes(r.digest): (r.keep_id, r.group_size) for r in again.read().collect()}
    assert len(after) == 4 and after[hashlib.sha256(ROWS[0][1].encode()).digest()] == (2, 3)
    rows = exact_dedup.digests(documents(spark, [(9, ROWS[0][1], "en", "a", 0)]))
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.assign(rows, again).collect()] == [(9, 2, 3, False)]


def test_the_index_is_joined_without_a_shuffle(spark):
    index = exact_dedup.DigestIndex(spark)
    index.append(documents(spark))
    plan = index.read()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_copies_are_counted_before_the_shuffle(spark):
    """A text that makes up most rows reaches the exchange once a task."""
    docs = spark.createDataFrame([(k, "hot" if k % 4 else f"text {k}") for k in range(8000)], "doc_id long, text string").repartition(6)
    rows = exact_dedup.digests(docs)
    found = rows.groupBy("digest").count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.index("Exchange hashpartitioning(digest") < plan.rindex("HashAggregate")
    index = exact_dedup.DigestIndex(spark)
    index.append_rows(rows)
    index.append_rows(rows)
    assert {r.group_size for r in index.read().collect()} == {2, 12000}


@pytest.mark.parametrize("slices", [1, 2, 5])
def test_slices_dont_change_the_result(spark, slices):
    rows = exact_dedup.digests(documents(spark))
    got = exact_dedup.assign(rows, exact_dedup.one_off(rows, slices)).collect()
    assert sorted(map(str, got)) == sorted(map(str, exact_dedup.dedup(documents(spark)).collect()))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abAB \n\t\x0b\x1cé", max_size=60))
def test_shingles(text):
    assert len(shingles.shingles(text)) == len(shingle_set(text))
    assert shingles.shingles(text).tolist() == shingles.shingles(text.replace("A", "a").replace("B", "b")).tolist()


def test_near_on_odd_rows(spark):
    got = near_dup.group(documents(spark)).collect()
    want = components((r[0], r[1]) for r in ROWS)
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            text = next(t for d, t, *_ in ROWS if d == r.doc_id)
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(shingle_set(text)), r.doc_id == want[r.doc_id])
    assert near_dup.group(empty(spark)).count() == 0
    kept = near_dup.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    assert {r.doc_id for r in kept.collect()} == {None} | {d for d, c in want.items() if d == c}


@pytest.fixture(scope="module")
def edited():
    """Chains of edits about the threshold, unrelated texts and texts that share a passage."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, passage = [], [word() for _ in range(40)]
    for family in range(12):
        text = [word() for _ in range(rng.choice((8, 40, 150)))]
        for _ in range(12):
            rows.append((len(rows) * 3 + 1, " ".join(text)))
            text = list(text)
            for _ in range(rng.randrange(0, max(2, len(text) // 25))):
                text[rng.randrange(len(text))] = word()
    rows += [(10_000 + k, " ".join([word() for _ in range(60)] + passage)) for k in range(60)]
    return rows


@pytest.mark.parametrize("tiles", [None, (7, 5)])
def test_near_equals_brute_force(spark, edited, tiles, monkeypatch):
    if tiles:  # so small that buckets and clusters are cut
        monkeypatch.setattr(near_dup, "TILE", tiles[0])
        monkeypatch.setattr(near_dup, "SIGNATURES", tiles[1])
    docs = spark.createDataFrame(edited, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dup.group(docs).collect()}
    assert got == components(edited)


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7)]
    label = {}
    for a, b in edges:
        if a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    found, _ = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in found.collect()} == label
    none, _ = connected_components(spark.createDataFrame([], "a long, b long"))
    assert none.count() == 0


def test_units_are_bounded_by_shingles(spark, monkeypatch):
    """Few but long texts are cut into several tiles too."""
    monkeypatch.setattr(near_dup, "TILE_SHINGLES", 300)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(14):
        text = list(base)
        for _ in range(rng.randrange(0, 4)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        rows.append((k * 2 + 1, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    units = []
    kept = near_dup.linked

    def spied(u, texts):
        units.append(u.groupBy("unit").sum("n_shingles").collect())
        return kept(u, texts)

    monkeypatch.setattr(near_dup, "linked", spied)
    assert {r.doc_id: r.component_id for r in near_dup.group(docs).collect()} == components(rows)
    assert len(units[0]) > 3 and max(r[1] for r in units[0]) < 14 * 110


def test_signatures_find_links_at_the_threshold():
    """Four thousand pairs of sets whose similarity is 0.75 exactly: all within the signature distance."""
    import numpy as np

    rng = np.random.default_rng(6)
    worst = 0
    for _ in range(4000):
        found = rng.integers(0, 2**63, 140).astype(np.uint64)  # 120 shared of 160
        a, b = np.sort(found), np.sort(np.r_[found[:120], rng.integers(0, 2**63, 20).astype(np.uint64)])
        x, y = (shingles.signature(s).view(np.uint16) for s in (a, b))
        worst = max(worst, int((x != y).sum()))
    assert worst <= near_dup.DISTANCE


def test_components_settle_exactly(spark):
    """A long path and a hub: the loop ends when each vertex has one edge, to a root."""
    edges = [(k, k + 1) for k in range(300)] + [(5000, 5000 + k) for k in range(1, 200)]
    found, _ = connected_components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.id: r.component for r in found.collect()}
    assert got == {k: 0 for k in range(301)} | {5000 + k: 5000 for k in range(200)}
