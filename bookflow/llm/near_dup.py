"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures, confirmed on full shingle sets.

1. Each document's set of word shingles gives a signature of 80 symbols of 16 bits (20 chunks of 4). Documents of equal
   sets are one class from here on, so a group of copies of any size is one row.
2. Index: a chunk with one symbol left out is a key, 80 keys a class. By the pigeonhole principle two signatures that
   differ in at most 39 of 80 symbols have a chunk that differs in at most one, so they share a key. At the similarity of
   0.75 symbols differ with chance 0.25: 39 lies 4.9 standard deviations out (one pair in a million is beyond), and more
   for closer pairs.
3. Hamming graph: in each bucket all classes are compared with the bucket's least class (a star); then classes of a
   bucket that this left in different clusters are compared with each other, in tiles. Edges join signatures at distance
   39 or less whose set sizes allow the similarity. Connected components are clusters; by 2, no link leaves its cluster.
4. Clusters are cut into tiles of about ``TILE`` classes, and of about ``TILE_SHINGLES`` shingles. A unit of work computes all its intersections of full sets (a matrix
   product over shared shingles) and returns a spanning forest of its links. First units are the tiles, each with the
   cluster's least class; then, in clusters of several tiles, the classes that aren't in that class's component meet each
   other and the rest. The components of all links are the answer.

No step gathers a bucket, cluster or component in one task beyond a tile, and none returns pairs within a group: units
return forests.

Defined results: null, empty and blank texts have no shingles and stay alone; repeated rows are one class; rows that
share an id but not the text are one document, compared by its greatest text; rows with a null id take part in no group
and come back with null ids, kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.llm.bpe import rows_of
from bookflow.llm.common import materialize, remove
from bookflow.llm.components import connected_components
from bookflow.llm.shingles import CHUNKS, LANES, digest, shingles, signature

#: Similarity: links have PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Most symbols that may differ: 2 * CHUNKS - 1, so that some chunk differs in at most one.
DISTANCE = 2 * CHUNKS - 1
#: Classes of a tile: of full sets, and of signatures.
TILE, SIGNATURES = 192, 2048
#: Shingles of a tile of full sets.
TILE_SHINGLES = 400_000
#: Pairs of signatures, and shingles, that make a task's work.
TASK_PAIRS, TASK_SHINGLES = 20_000_000, 4_000_000
#: A set is hot with more than one in HOT_SHARE of all rows.
HOT_SHARE = 1000
SIG = [f"s{c}" for c in range(CHUNKS)]
SET = ["d1", "d2", "n_shingles"]


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, d1, d2, n_shingles, s0..s19): what identifies the set, its size and its signature."""
    names = ["id", *SET, *SIG]

    def run(batches):
        for batch in (part for whole in batches for part in rows_of(whole)):
            rows = []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                rows.append([*digest(found), len(found), *(signature(found).tolist() if len(found) else [0] * CHUNKS)])
            columns = np.array(rows, np.int64).reshape(len(rows), len(names) - 1).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=names)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def differing(a: str, b: str) -> Column:
    """The number of differing 16-bit symbols of two signatures."""
    total = F.lit(0)
    for s in SIG:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        for shift in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))
    return total


def keys(classes: DataFrame) -> DataFrame:
    """(key, id): each chunk with each of its symbols left out. Equal keys of different chunks are kept apart by their number."""
    lanes = [F.xxhash64(F.lit(c * LANES + lane), F.col(s).bitwiseAND(F.lit(~(0xFFFF << 16 * lane) if lane < 3 else 0x0000FFFFFFFFFFFF).cast("long"))) for c, s in enumerate(SIG) for lane in range(LANES)]
    return classes.select("id", F.explode(F.array(*lanes)).alias("key"))


def sizes_allow(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def forest(left: np.ndarray, right: np.ndarray, size: int) -> list[int]:
    """The positions of those edges that join two trees, of edges between 0..size-1."""
    root = list(range(size))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = find(a), find(b)
        if a != b:
            root[a] = b
            kept.append(k)
    return kept


def tiled(rows: DataFrame, group: str, count: str, tile: int) -> DataFrame:
    """Rows with (unit, side): a group's rows are dealt to tiles of about ``tile`` rows, and each pair of tiles is a unit.

    A row comes once for each tile of its group; ``side`` is -1 in a unit of one tile, else 0 or 1.
    """
    tiles = F.ceil(F.col(count) / tile).cast("int")
    own = F.pmod(F.xxhash64("id"), tiles).cast("int")
    spread = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    return spread.select(
        *rows.columns,
        F.concat_ws("/", group, F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
        F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
    )


def tasks_for(spark, work: int | None, each: int) -> int:
    """How many tasks a stage gets whose cost isn't seen in its bytes: at least as many as any shuffle has."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(work or 0) // each))


def _bucket_edges(found: pd.DataFrame) -> pd.DataFrame:
    """Edges between classes of one unit of a bucket that are in different clusters."""
    ids, n, cluster, side = (found[c].to_numpy() for c in ("id", "n_shingles", "cluster", "side"))
    symbols = np.ascontiguousarray(found[SIG].to_numpy(np.int64)).view(np.uint16).reshape(len(found), -1)
    left, right = [], []
    for k in range(len(found) - 1):
        rest = slice(k + 1, None)
        near = (cluster[rest] != cluster[k]) & (100 * np.minimum(n[rest], n[k]) >= PERCENT * np.maximum(n[rest], n[k])) & ((side[rest] != side[k]) | (side[k] < 0))
        at = np.flatnonzero(near) + k + 1
        at = at[(symbols[at] != symbols[k]).sum(axis=1) <= DISTANCE]
        left.append(np.full(len(at), k))
        right.append(at)
    left, right = (np.concatenate([np.empty(0, np.int64), *x]) for x in (left, right))
    _, code = np.unique(cluster, return_inverse=True)
    kept = forest(code[left], code[right], len(found))
    return pd.DataFrame({"a": ids[left[kept]], "b": ids[right[kept]]})


def _links(found: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links between the classes of one unit, by full sets."""
    found = found.sort_values("id", kind="stable")
    ids, side = found["id"].to_numpy(), found["side"].to_numpy()
    sets = [shingles(t) for t in found["text"]]
    sizes = np.array([len(s) for s in sets], np.int64)
    every, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = times[at] > 1  # a shingle of one document is in no intersection
    at, owner = at[shared], owner[shared]
    number = np.cumsum(times > 1) - 1
    column = number[at]
    common = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 8192
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        lo, hi = np.searchsorted(column, (a, a + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owner[lo:hi], column[lo:hi] - a] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    linked = np.triu(100 * common >= PERCENT * union, 1)
    linked &= (side[:, None] != side[None, :]) | (side[:, None] < 0)
    left, right = np.nonzero(linked)
    kept = forest(left, right, len(sets))
    return pd.DataFrame({"a": ids[left[kept]], "b": ids[right[kept]]})


def hamming_clusters(classes: DataFrame) -> tuple[DataFrame, list[str]]:
    """(id, component): components of the graph of signatures at distance at most DISTANCE, single classes left out."""
    spark = classes.sparkSession
    all_keys = keys(classes)
    shared = all_keys.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    members, m_path = materialize(all_keys.join(shared, "key"), "buckets")
    stars = members.filter("id <> first").select("first", "id").distinct()
    a, b = classes.alias("a"), classes.alias("b")
    star_edges, e_path = materialize(
        stars.join(a, F.col("first") == F.col("a.id")).drop(F.col("a.id")).join(b, stars["id"] == F.col("b.id")).filter(sizes_allow("a.n_shingles", "b.n_shingles")).filter(differing("a", "b") <= DISTANCE).select(F.col("first").alias("a"), stars["id"].alias("b")),
        "stars",
    )
    clusters, c_path = connected_components(star_edges, "clusters")
    labelled = members.select("key", "members", "id").join(clusters, "id", "left").withColumn("cluster", F.coalesce("component", "id")).drop("component")
    # Buckets that hold more than one cluster: their classes meet each other.
    mixed, x_path = materialize(labelled.groupBy("key").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.first("members").alias("size")).filter("low <> high").select("key", "size"), "mixed")
    tasks = tasks_for(spark, mixed.agg(F.sum(F.col("size") * (F.col("size") + 64))).first()[0], TASK_PAIRS)
    open_rows = labelled.join(mixed.select("key"), "key").join(classes.select("id", "n_shingles", *SIG), "id")
    more = tiled(open_rows, "key", "members", SIGNATURES).repartition(tasks, "unit").groupBy("unit").applyInPandas(_bucket_edges, "a long, b long").distinct()
    merged, f_path = connected_components(star_edges.unionAll(more), "clusters")
    for path in (m_path, e_path, c_path, x_path):
        remove(spark, path)
    return merged, [f_path]


def tiles_of(members: str, shingled: str) -> Column:
    """Tiles that hold about TILE classes and about TILE_SHINGLES shingles each."""
    return F.ceil(F.greatest(F.col(members) / TILE, F.col(shingled) / TILE_SHINGLES)).cast("int")


def star_units(sized: DataFrame) -> DataFrame:
    """(unit, side, id, n_shingles): each tile of a cluster with the cluster's least class, so that most of a family is linked at linear cost."""
    tiles = tiles_of("members", "shingled")
    tile = lambda c: F.pmod(F.xxhash64(c), tiles).cast("int")
    own = sized.select(F.concat_ws("/", "component", tile("id")).alias("unit"), F.lit(-1).alias("side"), "id", "n_shingles")
    heads = sized.filter((F.col("id") == F.col("component")) & (tiles > 1)).withColumn("home", tile("id")).select("component", "n_shingles", "home", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"))
    return own.unionByName(heads.filter("tile <> home").select(F.concat_ws("/", "component", "tile").alias("unit"), F.lit(-1).alias("side"), F.col("component").alias("id"), "n_shingles"))


def rest_units(sized: DataFrame, first: DataFrame) -> DataFrame:
    """(unit, side, id, n_shingles) of what star units leave open: in clusters of several tiles, classes that aren't with the
    least class yet meet each other and the rest. Those that are with it don't meet: they are one component already."""
    label = first.withColumnRenamed("component", "label")
    large = sized.filter(tiles_of("members", "shingled") > 1).join(label, "id", "left").select("id", "component", "n_shingles", F.coalesce(F.col("label") == F.col("component"), F.lit(False)).alias("with_head"))
    counted = {"inside": F.count_if("with_head"), "outside": F.count_if(~F.col("with_head")), "inside_shingles": F.sum(F.when(F.col("with_head"), F.col("n_shingles")).otherwise(0)), "outside_shingles": F.sum(F.when(F.col("with_head"), 0).otherwise(F.col("n_shingles")))}
    counts = large.groupBy("component").agg(*(c.alias(n) for n, c in counted.items()))
    rows = large.join(counts.filter("outside > 0"), "component")
    ins, outs = tiles_of("inside", "inside_shingles"), tiles_of("outside", "outside_shingles")
    own = F.pmod(F.xxhash64("id"), F.when(F.col("with_head"), ins).otherwise(outs)).cast("int")
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    rows = rows.withColumn("own", own)
    out, inside = rows.filter("NOT with_head"), rows.filter("with_head")
    each_other = out.withColumn("other", F.explode(up_to(outs))).select(F.concat_ws("/", "component", F.lit("o"), F.least("own", "other"), F.greatest("own", "other")).alias("unit"), F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "id", "n_shingles")
    to_inside = out.withColumn("other", F.explode(F.when(ins > 0, up_to(ins)))).select(F.concat_ws("/", "component", F.lit("i"), "own", "other").alias("unit"), F.lit(0).alias("side"), "id", "n_shingles")
    from_inside = inside.withColumn("other", F.explode(up_to(outs))).select(F.concat_ws("/", "component", F.lit("i"), "other", "own").alias("unit"), F.lit(1).alias("side"), "id", "n_shingles")
    return each_other.unionAll(to_inside).unionAll(from_inside)


def linked(units: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of each unit's links."""
    spark = units.sparkSession
    units, path = materialize(units, "units")
    tasks = tasks_for(spark, units.agg(F.sum("n_shingles")).first()[0], TASK_SHINGLES)
    found, _ = materialize(units.join(texts, "id").select("unit", "side", "id", "text").repartition(tasks, "unit").groupBy("unit").applyInPandas(_links, "a long, b long").distinct(), "links")
    remove(spark, path)
    return found


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    spark = docs.sparkSession
    sketched, _ = materialize(sketches(docs, id_col, text_col), "sketches")
    known = sketched.filter("n_shingles > 0 and id is not null")
    classes, k_path = materialize(known.groupBy(*SET).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), *(F.min(s).alias(s) for s in SIG)), "classes")
    clusters, held = hamming_clusters(classes)
    clusters = clusters.join(classes.select("id", "n_shingles"), "id")
    sized, s_path = materialize(clusters.join(clusters.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingled")), "component"), "sized")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts, t_path = materialize(texts.join(sized.select("id"), "id", "left_semi").groupBy("id").agg(F.max("text").alias("text")), "texts")
    links = linked(star_units(sized), texts)
    first, f_path = connected_components(links, "near-dup")
    more = linked(rest_units(sized, first), texts)
    components, n_path = connected_components(links.unionAll(more), "near-dup")
    of_class, _ = materialize(classes.select(*SET, "id", "copies").join(components, "id", "left").select(*SET, "copies", F.coalesce("component", "id").alias("component_id")), "classes")
    # Sets of more than a thousandth of all rows are fewer than a thousand: their rows meet them by broadcast.
    limit = (classes.agg(F.sum("copies")).first()[0] or 0) / HOT_SHARE
    for path in (*held, s_path, t_path, f_path, n_path, k_path):
        remove(spark, path)
    hot = F.broadcast(of_class.filter(F.col("copies") > limit).drop("copies"))
    rows = sketched.select("id", *SET)
    found = rows.join(hot, SET).unionByName(rows.join(hot, SET, "left_anti").join(of_class.filter(F.col("copies") <= limit).drop("copies").hint("merge"), SET, "left"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return found.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group the document of the smallest id."""
    gone = f"gone_{uuid.uuid4().hex[:8]}"
    dropped, _ = materialize(group(docs, id_col, text_col).filter("not kept").select(F.col(id_col).alias(gone)).distinct(), "near-dup-gone")
    return docs.join(dropped, F.col(id_col) == F.col(gone), "left_anti")
