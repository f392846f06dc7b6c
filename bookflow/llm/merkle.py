"""A Merkle manifest of a table: one hash for the whole, and for every row the few hashes that prove it belongs.

A leaf is the SHA-256 of a row's fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. The leaves of a
group, by id, are the lowest nodes of the group's tree; every ``WIDTH`` neighbours make one node of the next level, the
SHA-256 of their digests in hex, until one is left. The groups' last nodes, by group, make the table's tree alike.

The manifest (a folder in shared storage) holds a parent's *preimage*, its children's digests one after another:

* ``leaves``: (id, grp, at, n, hash) of every row,
* ``nodes/level=K``: (grp, at, n, preimage) of level K of the groups' trees, ``roots/level=K`` of the table's tree,
* ``groups``: (grp, name, n, count, subroot); ``n``: the group's leaves, ``count``: the groups.

A leaf's proof is its ancestors' preimages: in each one it, or its ancestor below, has a slot of 64 characters. Without the
slots, they are the siblings; with the slots replaced from the bottom up, they give the root of the changed table.

Positions come from one exchange by ranges of (group, id, leaf) and the ranges' counts, so no group is sorted in one task,
however large; groups are numbered alike. Trees are built by levels, an eighth of the rows each; then every level's nodes get their ancestors from the
level above, from the top down, so rows meet one table an eighth of their number. Text is hashed where it is read and is
never shuffled.

Defined results: null fields are ``-``; a null group comes first, a null id first in its group; rows that repeat an id are
ordered by their leaves; of one row alone the leaf is the root and the proof is the hash of nothing; an empty table gives no
rows; extra columns aren't hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.llm.common import folders, materialize, remove, scratch

#: Children of a node.
WIDTH = 8
#: Characters of a digest.
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHAIN = "array<struct<preimage: string, slot: int>>"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(values: list[Column]) -> Column:
    """The hash of a row's fields."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return sha(F.concat(*parts))


def lowered(text: Column) -> Column:
    """A-Z to lower case, all else as it is."""
    return F.when(text.rlike("[A-Z]"), F.translate(text, UPPER, LOWER)).otherwise(text)


def tampered_third(id_col: str) -> Column:
    """True for the rows whose id's CRC-32 (of its decimal text) is divisible by three."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0, F.lit(False))


def positions(rows: DataFrame, keys: list[str], label: str) -> tuple[DataFrame, str]:
    """Rows with ``pos``, their number in the order of ``keys`` from 0, and the folder that holds them.

    Sorted ranges are written; a row's number is its place in its range plus what earlier ranges hold: a row for each range
    goes to the driver and back.
    """
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The built-in row id has the range in its upper bits, the place in it in the lower 33.
    held, path = materialize(ranged.select("*", F.monotonically_increasing_id().alias("place")), label)
    held = held.withColumn("part", F.shiftright("place", 33))
    sizes = sorted((r["part"], r["count"]) for r in held.groupBy("part").count().collect())
    starts, total = [], 0
    for part, size in sizes:
        starts.append((part, total))
        total += size
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "part long, before long"))
    return held.join(offsets, "part").select(*rows.columns, (F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("pos")), path


def grow(nodes: DataFrame, path: str, largest: int) -> list[DataFrame]:
    """Write the levels above (grp, at, hash, n): (grp, at, n, preimage), lowest first.

    ``n`` is how many nodes the group has at the bottom. A level has the nodes of the groups that have several below it.
    """
    spark, levels, span = nodes.sparkSession, [], 1
    while span < largest:
        here = f"{path}/level={len(levels) + 1}"
        below = nodes.filter(F.col("n") > span).groupBy("grp", F.floor(F.col("at") / WIDTH).cast("long").alias("up"))
        runs = below.agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "hash"))).alias("below"))  # at most WIDTH each
        runs.select("grp", F.col("up").alias("at"), "n", F.array_join(F.col("below.hash"), "").alias("preimage")).write.option("compression", "zstd").parquet(here)
        levels.append(spark.read.schema("grp long, at long, n long, preimage string").parquet(here))
        span *= WIDTH
        nodes = levels[-1].withColumn("hash", sha(F.col("preimage")))
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(grp, n, hash) of each group's last node."""
    found = nodes.filter("n = 1").select("grp", "n", "hash")
    for k, level in enumerate(levels, 1):
        found = found.unionByName(level.filter(F.col("n") <= WIDTH**k).select("grp", "n", sha(F.col("preimage")).alias("hash")))
    return found


def with_chains(nodes: DataFrame, levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Nodes (grp, at, n, ...) with ``chain``: their ancestors' preimages and their slots in them, lowest first.

    ``above``: (grp, n, chain) of each group's last node, which the chains end with. From the top down each level joins the
    one above it; a group's last node joins ``above`` in the place of a parent.
    """
    parents = None
    for k in range(len(levels), -1, -1):
        ends = above.filter((F.col("n") <= WIDTH**k) & (F.col("n") > WIDTH**k // WIDTH)).select("grp", F.lit(0).cast("long").alias("up"), F.lit(None).cast("string").alias("over"), "chain")
        upper = ends if parents is None else ends.unionByName(parents)
        level = levels[k - 1] if k else nodes
        slot = F.struct(F.col("over").alias("preimage"), F.pmod("at", F.lit(WIDTH)).cast("int").alias("slot"))
        found = level.withColumn("up", F.floor(F.col("at") / WIDTH).cast("long")).join(upper, ["grp", "up"])
        chain = F.when(F.col("over").isNull(), F.col("chain")).otherwise(F.concat(F.array(slot), F.col("chain")))
        if not k:
            return found.select(*nodes.columns, chain.alias("chain"))
        parents = found.select("grp", F.col("at").alias("up"), F.col("preimage").alias("over"), chain.alias("chain"))


def siblings(step: Column) -> tuple[Column, Column]:
    """What stands before and after a node's slot in its parent's preimage."""
    at = step["slot"] * DIGEST
    return F.substring(step["preimage"], F.lit(1), at), F.substring(step["preimage"], at + DIGEST + 1, F.lit(WIDTH * DIGEST))


def proof(chain: Column) -> Column:
    """All siblings' digests, from the lowest level up."""
    return F.array_join(F.transform(chain, lambda step: F.concat(*siblings(step))), "")


def folded(chain: Column, start: Column) -> Column:
    """The root that a leaf gives with its siblings."""

    def splice(node: Column, step: Column) -> Column:
        left, right = siblings(step)
        return sha(F.concat(left, node, right))

    return F.aggregate(chain, start, splice)


class Manifest:
    """A manifest's tables, by its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.leaves, self.groups = spark.read.parquet(f"{path}/leaves"), spark.read.parquet(f"{path}/groups")
        self.nodes, self.over = self._levels("nodes"), self._levels("roots")
        self.root = self._root()

    def _levels(self, name: str) -> list[DataFrame]:
        found = sorted(int(f.split("=")[1]) for f in folders(self.spark, f"{self.path}/{name}"))
        return [self.spark.read.schema("grp long, at long, n long, preimage string").parquet(f"{self.path}/{name}/level={k}") for k in found]

    def _root(self) -> str | None:
        """The hash of the whole table; None where it is empty."""
        row = tops(roots_of(self.groups), self.over).first()
        return row["hash"] if row else None

    def paths(self) -> DataFrame:
        """Every leaf with its group's last hash and the chain of its ancestors."""
        single = self.spark.createDataFrame([(0, [])], f"grp long, chain {CHAIN}").crossJoin(self.groups.agg(F.count(F.lit(1)).alias("n")))  # one row each
        of_groups = with_chains(roots_of(self.groups), self.over, single).select(F.col("at").alias("grp"), "chain")
        above = self.groups.select("grp", "n", "subroot").join(of_groups, "grp")
        found = with_chains(self.leaves, self.nodes, above.select("grp", "n", "chain"))
        return found.join(self.groups.select("grp", "name", "subroot"), "grp")


def roots_of(groups: DataFrame) -> DataFrame:
    """The groups as the bottom nodes of the table's tree."""
    return groups.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("at"), F.col("count").alias("n"), F.col("subroot").alias("hash"))


def write(docs: DataFrame, path: str, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, also: dict[str, Column] | None = None) -> Manifest:
    """Hash every row, build the trees and write the manifest. ``also``: columns to keep beside a leaf."""
    spark, also = docs.sparkSession, also or {}
    hashed, hashes = materialize(docs.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("name"), leaf([F.col(f) for f in fields]).alias("hash"), *(c.alias(k) for k, c in also.items())), "leaves")
    placed, places = positions(hashed, ["name", "id", "hash"], "placed")
    sizes, named = materialize(placed.groupBy("name").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n")), "groups")
    groups, numbers = positions(sizes, ["name"], "group-numbers")
    count = sizes.count()
    groups = groups.select(F.col("pos").alias("grp"), "name", "start", "n", F.lit(count).cast("long").alias("count"))
    of = groups.select("grp", F.col("name").alias("group_name"), "start", "n")
    leaves = placed.join(of, F.col("name").eqNullSafe(F.col("group_name"))).select("id", "grp", (F.col("pos") - F.col("start")).alias("at"), "n", "hash", *also)
    leaves.write.option("compression", "zstd").parquet(f"{path}/leaves")
    bottom = spark.read.schema(leaves.schema).parquet(f"{path}/leaves")
    levels = grow(bottom, f"{path}/nodes", sizes.agg(F.max("n")).first()[0] or 0)
    subroots = tops(bottom, levels).select("grp", F.col("hash").alias("subroot"))
    groups.drop("start").join(subroots, "grp").write.parquet(f"{path}/groups")
    grow(roots_of(spark.read.parquet(f"{path}/groups")), f"{path}/roots", count)
    for folder in (hashes, places, named, numbers):
        remove(spark, folder)
    return Manifest(spark, path)


def verify(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, text_col: str = "text", path: str | None = None) -> DataFrame:
    """Every row's leaf, roots and proof, and the root that it gives after a third of the rows were tampered with.

    A tampered row's text is lower-cased (A-Z); folding its leaf with the untampered siblings shows whether that changed it.
    """
    changed = leaf([lowered(F.col(f)) if f == text_col else F.col(f) for f in fields])
    manifest = write(docs, path or scratch(docs.sparkSession, "merkle"), id_col, group_col, fields, {"tampered": F.when(tampered_third(id_col), changed)})
    found = manifest.paths().withColumn("folded_root", folded(F.col("chain"), F.coalesce("tampered", "hash")))
    root = F.lit(manifest.root)
    return found.select(F.col("id").alias(id_col), F.col("hash").alias("leaf"), "subroot", root.alias("root"), sha(proof(F.col("chain"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))
