"""Fingerprints, ranked search and the Merkle manifest against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bookflow.llm import fingerprint, lexical, merkle, queries
from tests.llm.helpers import DATA, ROWS, documents, empty

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
order = lambda row: tuple((x is not None, x) for x in row)


# Fingerprints.
def plain_digest(text):
    """Counts by a dictionary, quartiles by sorting."""
    raw = (text or "").encode()
    if not raw:
        return "00" * 257
    counts = Counter()
    padded = b"\0\0" + raw + b"\0\0"
    for k in range(len(padded) - 2):
        h = (int.from_bytes(padded[k : k + 3], "big") * 0x9E3779B1) % 2**32
        h ^= h >> 15
        counts[(h * 0x85EBCA77) % 2**32 >> 22] += 1
    in_order = sorted(counts[b] for b in range(1024))
    cuts = [in_order[255], in_order[511], in_order[767]]
    bits = "".join(format(sum(counts[b] > c for c in cuts), "02b") for b in range(1024))
    return format(min(255, round(8 * math.log2(1 + len(raw)))), "02x") + format(int(bits, 2), "0512x")


def plain_likeness(x, y):
    a, b = bytes.fromhex(x), bytes.fromhex(y)
    steps = sum(abs((p >> s & 3) - (q >> s & 3)) for p, q in zip(a[1:], b[1:]) for s in (0, 2, 4, 6)) + min(64, abs(a[0] - b[0]))
    return 1.0 if x == y else 1 - min(1.0, steps / 1280)


def beside(rows):
    """Results of rows in order, each with the next one, the last with the first."""
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        own, other = plain_digest(text), plain_digest(changed)
        out.append((doc_id, len(text), sha(changed), own, other, plain_likeness(own, other), plain_likeness(own, plain_digest(after))))
    return out


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"])))
def test_digest(text):
    assert fingerprint.digest(text).hex() == plain_digest(text)


def test_neighbours(spark):
    rows = [(d, t) for d, t, *_ in ROWS]
    rows = [(d, t) for k, (d, t) in enumerate(rows) if (d, t) not in rows[:k]] + [(12, rows[11][1])]  # the repeated row stays repeated
    want = beside(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    for parts in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = [tuple(r) for r in fingerprint.with_neighbours(documents(spark)).collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
        assert sorted(got, key=order) == sorted(want, key=order)
    assert fingerprint.with_neighbours(empty(spark)).count() == 0
    alone = fingerprint.with_neighbours(documents(spark, ROWS[:1])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0 and alone[0].edited_sha256 == sha(ROWS[0][1][: len(ROWS[0][1]) - len(ROWS[0][1]) // 2] + ROWS[0][1][: len(ROWS[0][1]) // 2])
    assert {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(documents(spark)).collect()} == {d: plain_digest(t) for d, t in rows}


def test_fingerprint_query_on_the_whole_table(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in queries.op11_fingerprint(spark, DATA).collect())
    assert got == sorted(beside(rows))
    near = np.array([r[5:] for r in got])
    long = np.array([r[1] >= 200 for r in got])
    assert (near[long, 0] > near[long, 1]).mean() > 0.98  # half a text is more alike than another text


# Ranked search.
def ranking(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(terms(t))) for d, t in docs]
    n = sum(1 for _, c in held if c)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n // total
            scores.append((-sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in Counter(terms(text)).items() if c[t]), d is not None, d or 0, d))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(s for s in scores if s[0] < 0)[:k], 1)]
    return out


ITEMS = [(1, "word1 word2 word59 Other other"), (1, "a"), (2, None), (3, ""), (4, "zzz"), (5, "one ONE two é 日本語 the"), (None, "same lorem-ipsum x"), (7, "same same x9 XXX")]


@pytest.mark.parametrize("limits", [(4096, 500_000, 1 << 23), (3, 40, 20), (1, 1, 1)])
def test_ranked_search(spark, monkeypatch, limits):
    for name, value in zip(("BLOCK_DOCS", "BLOCK_POSTINGS", "BATCH_BYTES"), limits):
        monkeypatch.setattr(lexical, name, value)
    items = spark.createDataFrame([(*r, 1, "x") for r in ITEMS], "item_id long, text string, rank int, doc_id string")
    for k in (2, 100):
        got = [tuple(r) for r in lexical.rank_all(documents(spark), items, k).collect()]
        want = ranking([(d, t) for d, t, *_ in ROWS], [r for r in ITEMS if r != (1, "a")], k)
        assert sorted(got, key=order) == sorted(want, key=order)
    assert lexical.rank_all(empty(spark), items).count() == 0
    assert lexical.rank_all(documents(spark), items.filter("false")).count() == 0
    assert lexical.rank_all(documents(spark, [(1, None, "en", "a", 0), (2, " - ", "en", "a", 0)]), items).count() == 0


def test_many_copies_and_common_terms(spark):
    """Ties over thousands of equal documents go to smaller ids, wherever they lie."""
    rows = [(k, "alpha beta gamma" if k % 3 else f"alpha delta{k % 7} beta beta") for k in range(5000)]
    items = [(1, "alpha beta"), (2, "gamma delta3"), (3, "beta beta alpha delta0")]
    docs = spark.createDataFrame([(-d % 5000, t) for d, t in rows], "doc_id long, text string").repartition(7)
    got = [tuple(r) for r in lexical.rank_all(docs, spark.createDataFrame(items, "item_id long, text string"), 10).collect()]
    assert sorted(got) == ranking([(-d % 5000, t) for d, t in rows], items, 10)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1), st.integers(1, 10**6), st.integers(1, 10**9), st.integers(1, 10**12))
def test_impacts_bound_the_saturation(tf, n, documents_, total):
    exact = lexical.saturation(np.array(tf), np.full(len(tf), n), documents_ % 1000 + 1, total)
    impact = -(-exact // lexical.STEP)
    assert (exact <= impact * lexical.STEP).all() and (exact > (impact - 1) * lexical.STEP).all() and impact.max() <= 255


def engine():
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_search_query_equals_sql(spark):
    got = sorted(tuple(r) for r in queries.op12_ranked_search(spark, DATA).select("item_id", "rank", "doc_id", "score").collect())
    assert got == sorted(engine().execute(queries.ORACLE_SQL["op12_ranked_search"]).fetchall())


def test_an_index_serves_later_searches(spark, tmp_path):
    lexical.build(documents(spark), f"{tmp_path}/index")
    for items in ([(1, "word3")], [(2, "same"), (3, "tail of")]):
        got = [tuple(r) for r in lexical.search(spark, f"{tmp_path}/index", spark.createDataFrame(items, "item_id long, text string"), 4).collect()]
        assert sorted(got, key=order) == sorted(ranking([(d, t) for d, t, *_ in ROWS], items, 4), key=order)


# Merkle manifest.
def verified(rows):
    """Rows (doc_id, source, lang, n_chars, text) to what the query returns, from trees in memory."""
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(show, (*r[:4], text))))

    def tree(hashes):
        paths, members = [[] for _ in hashes], [[k] for k in range(len(hashes))]
        while len(hashes) > 1:
            up, more = [], []
            for a in range(0, len(hashes), 8):
                run = hashes[a : a + 8]
                for s in range(len(run)):
                    for k in members[a + s]:
                        paths[k].append(("".join(run[:s]), "".join(run[s + 1 :])))
                up.append(sha("".join(run)))
                more.append([k for m in members[a : a + 8] for k in m])
            hashes, members = up, more
        return hashes[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees.append(tree([leaf(r, r[4]) for r in groups[g]]))
    root, over = tree([t[0] for t in trees])
    out = []
    for g, (subroot, paths), above in zip(names, trees, over):
        for r, path in zip(groups[g], paths):
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            node = leaf(r, text)
            for left, right in path + above:
                node = sha(left + node + right)
            out.append((r[0], leaf(r, r[4]), subroot, root, sha("".join(a + b for a, b in path + above)), node, node == root))
    return out


def test_merkle(spark):
    want = verified([(d, source, lang, n, t) for d, t, lang, source, n in ROWS])
    assert sorted((tuple(r) for r in merkle.verify(documents(spark)).collect()), key=order) == sorted(want, key=order)
    assert {r[-1] for r in want} == {True, False}
    assert merkle.verify(empty(spark)).count() == 0
    (alone,) = merkle.verify(documents(spark, ROWS[:1])).collect()
    assert alone.leaf == alone.subroot == alone.root == alone.folded_root and alone.proof_sha256 == sha("") and alone.verified


@pytest.mark.parametrize("sizes", [(8, 9, 64, 65, 1), (1,) * 75, (600,)])
def test_merkle_of_many_shapes(spark, sizes):
    rows = [(1000 * g + k, f"Text {k} É", f"g{g}" if g else None, None, k) for g, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame([(d, t, lang, s, n) for d, t, lang, s, n in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5, F.rand(1))
    got = sorted(tuple(r) for r in merkle.verify(docs).collect())
    assert got == sorted(verified([(d, s, lang, n, t) for d, t, lang, s, n in rows]))


def test_a_manifest_is_read_again(spark, tmp_path):
    made = merkle.write(documents(spark), f"{tmp_path}/manifest")
    again = merkle.Manifest(spark, f"{tmp_path}/manifest")
    assert made.root == again.root and again.paths().count() == len(ROWS)
    other = merkle.write(documents(spark, ROWS[1:]), f"{tmp_path}/other")
    assert other.root != made.root


def test_merkle_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(tuple(r) for r in queries.op13_merkle(spark, DATA).collect()) == sorted(verified(rows))


def test_a_row_group_of_the_index_holds_few_blocks(spark, tmp_path):
    """A batch of the reader is a row group: blocks of a few MB each must not all come at once, however many a task writes."""
    import pyarrow.parquet as pq

    docs = spark.range(0, 6 * lexical.BLOCK_DOCS, 1, 1).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"))
    lexical.build(docs, f"{tmp_path}/index")
    files = [pq.ParquetFile(p).metadata for p in (tmp_path / "index/blocks").glob("*.parquet")]
    assert sum(f.num_rows for f in files) == 6
    assert all(f.row_group(k).num_rows <= 2 for f in files for k in range(f.num_row_groups))
