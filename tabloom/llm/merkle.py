"""Merkle manifest of a table, built by appending, with witnesses that grow.

Leaves are SHA-256 digests as lowercase hex text. Per group they are ordered by key and
cut into aligned blocks of ``16 ** BLOCK_LEVELS`` leaves. A task appends the leaves of one
block to a ``Frontier``: its open subtrees share their run of siblings, so a sibling that
completes extends the partial witnesses of all of them at once. The root of a block is
appended, in the same way, to the next storey, whose blocks hold block roots; storeys
follow until each group has one node. The groups' roots are the leaves of a last tree.
Witnesses above a block are kept once a block and meet its leaves in a cogroup.

``append`` adds rows to a manifest: only blocks that were not full, and new ones, are
hashed again; full blocks keep their roots.

Defined results: NULL groups and keys come first; rows of equal key are ordered by their
leaf, and rows equal in both are leaves of their own with interchangeable places; a group
of one leaf has it as root, an empty table gives no rows; a witness without siblings is the
digest of the empty text; extra columns are ignored. A block is bounded whatever the size of
a group: no group, and no list of groups, meets in one task or on the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_or_not, stage

#: Fixed by the contract: nodes of a run.
FANOUT = 16
#: Levels that one task closes: 4,096 leaves a block.
BLOCK_LEVELS = 3
SPAN = FANOUT**BLOCK_LEVELS
#: Characters of a digest.
WIDTH = 64


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def leaf(*fields: Column) -> Column:
    """Digest of a row: each field as its bytes, a colon and its text, or ``-`` for NULL."""
    parts = []
    for field in fields:
        text = field.cast("string")
        sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(sized, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def height(nodes: int) -> int:
    """Levels until one node remains."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FANOUT), levels + 1
    return levels


class Frontier:
    """Appends digests to a tree of ``levels`` levels and keeps the witness of each.

    ``runs[l]`` are the runs of level ``l``; the last is open. A witness is a list of
    (run, place): it is attached when a node is appended and grows with its run.
    """

    def __init__(self, levels: int) -> None:
        self.levels = levels
        self.runs: list[list[list[str]]] = [[[]] for _ in range(levels)]
        self.root: str | None = None

    def append(self, node: str, level: int = 0) -> None:
        if level == self.levels:
            self.root = node
            return
        run = self.runs[level][-1]
        run.append(node)
        if len(run) == FANOUT:
            self._close(level)

    def _close(self, level: int) -> None:
        node = digest("".join(self.runs[level][-1]))
        self.runs[level].append([])
        self.append(node, level + 1)

    def finish(self) -> str | None:
        """Close what is open, from below, and give the root."""
        for level in range(self.levels):
            if self.runs[level][-1]:
                self._close(level)
        return self.root

    def witnesses(self) -> list[list[tuple[str, str]]]:
        """Per appended digest: the siblings (left of it, right of it), level by level."""
        joined = [["".join(run) for run in runs] for runs in self.runs]
        appended = sum(map(len, self.runs[0])) if self.levels else 1
        return [
            [
                (
                    joined[level][at // FANOUT ** (level + 1)][: at // FANOUT**level % FANOUT * WIDTH],
                    joined[level][at // FANOUT ** (level + 1)][(at // FANOUT**level % FANOUT + 1) * WIDTH :],
                )
                for level in range(self.levels)
            ]
            for at in range(appended)
        ]


def fold(node: str, steps: list[tuple[str, str]]) -> str:
    """The root that a digest and its siblings give."""
    for left, right in steps:
        node = digest(left + node + right)
    return node


def _grown(digests: list[str], total: int) -> Frontier:
    frontier = Frontier(min(BLOCK_LEVELS, height(total)))
    for d in digests:
        frontier.append(d)
    frontier.finish()
    return frontier


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos``, the place in the group ``g`` by ``order``, and ``total``, the group's rows.

    The rows are range-sorted and written; a group's places go on from one part to the
    next. Rows that are equal in ``order`` are spread by their place in the input.
    """
    by = ["g", *order, "__at"]
    sorted_rows = (
        rows.withColumn("__at", F.monotonically_increasing_id())
        .repartitionByRange(*by).sortWithinPartitions(*by).drop("__at")
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__place", F.monotonically_increasing_id())
    )
    placed = stage(sorted_rows, "merkle-places")
    # One row per group and part of it.
    group = Window.partitionBy("g")
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stage(
        placed.groupBy("g", "__part")
        .agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first"))
        .select(
            "g", "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
            F.sum("__n").over(group).alias("total"),
        ),
        "merkle-parts",
    )
    return placed.join(small_or_not(parts), ["g", "__part"]).withColumn(
        "pos", F.col("__place") + F.col("__shift")
    ).drop("__part", "__place", "__shift")


def _climb(nodes: DataFrame) -> DataFrame:
    """(g, pos, steps, parent, total) of nodes (g, pos, digest, total): one storey of blocks."""

    def climb(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        frontier = _grown(block["digest"].to_pylist(), block["total"][0].as_py())
        steps = [[{"l": left, "r": right} for left, right in w] for w in frontier.witnesses()]
        return pa.table({
            "g": block["g"], "pos": block["pos"],
            "steps": pa.array(steps, pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))),
            "parent": pa.array([frontier.root] * len(block), pa.string()),
            "total": block["total"],
        })

    return nodes.withColumn("block", F.floor(F.col("pos") / SPAN)).groupBy("g", "block").applyInArrow(
        climb, "g string, pos long, steps array<struct<l:string,r:string>>, parent string, total long"
    )


def _paths(nodes: DataFrame) -> DataFrame:
    """(g, pos, steps, root) of nodes (g, pos, digest, total): their witnesses up to the group's root."""
    nodes = stage(nodes.select("g", "pos", "digest", "total"), "merkle-nodes")
    largest = nodes.agg(F.max("total")).first()[0] or 0
    storeys = []
    while largest > 1:
        made = stage(_climb(nodes), "merkle-storey")
        storeys.append(made)
        nodes = made.filter(F.col("pos") % SPAN == 0).select(
            "g", F.floor(F.col("pos") / SPAN).alias("pos"), F.col("parent").alias("digest"),
            F.ceil(F.col("total") / SPAN).alias("total"),
        )
        largest = -(-largest // SPAN)
    empty = F.array().cast("array<struct<l:string,r:string>>")
    paths = nodes.select("g", "pos", empty.alias("steps"), F.col("digest").alias("root"))
    for made in reversed(storeys):
        above = paths.select("g", F.col("pos").alias("__above"), F.col("steps").alias("__more"), "root")
        paths = (
            made.withColumn("__above", F.floor(F.col("pos") / SPAN)).join(above, ["g", "__above"])
            .select("g", "pos", F.concat("steps", "__more").alias("steps"), "root")
        )
    return paths


@dataclass
class Manifest:
    """``leaves`` (g, id, leaf, other, pos, total) and ``blocks`` (g, block, digest, n), both written."""

    leaves: DataFrame
    blocks: DataFrame

    def block_paths(self) -> DataFrame:
        """(g, block, steps, subroot, root): witnesses from the block's root to the table's."""
        sizes = self.blocks.groupBy("g").agg(F.ceil(F.sum("n") / SPAN).alias("total"))
        nodes = self.blocks.join(small_or_not(sizes), "g")
        inner = stage(
            _paths(nodes.select("g", F.col("block").alias("pos"), "digest", "total"))
            .withColumnRenamed("root", "subroot"),
            "merkle-paths",
        )
        subroots = inner.filter("pos = 0").select(
            F.lit("").alias("g"), F.col("g").alias("name"), F.col("subroot").alias("digest")
        )
        placed = positions(subroots, ["name"])
        outer = _paths(placed).select("pos", F.col("steps").alias("__more"), "root")
        top = stage(
            placed.join(outer, "pos").select(F.col("name").alias("g"), "__more", "root"), "merkle-top"
        )
        return inner.join(small_or_not(top, rows=10_000), "g").select(
            "g", F.col("pos").alias("block"), F.concat("steps", "__more").alias("steps"), "subroot", "root"
        )

    def proofs(self) -> DataFrame:
        """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

        The fold starts from ``other`` where it isn't NULL, and else from the leaf.
        """
        kind = self.leaves.schema["id"].dataType

        def prove(rows: pa.Table, above: pa.Table) -> pa.Table:
            if not len(rows) or not len(above):
                return pa.table({f: [] for f in fields})
            rows = rows.sort_by("pos")
            leaves, others = rows["leaf"].to_pylist(), rows["other"].to_pylist()
            top = above["steps"][0].as_py()
            rest = [(s["l"], s["r"]) for s in top]
            tail = "".join(left + right for left, right in rest)
            subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
            frontier = _grown(leaves, rows["total"][0].as_py())
            proofs, folded = [], []
            for own, other, steps in zip(leaves, others, frontier.witnesses(), strict=True):
                proofs.append(digest("".join(left + right for left, right in steps) + tail))
                folded.append(fold(other or own, steps + rest))
            return pa.table({
                "id": rows["id"], "leaf": rows["leaf"],
                "subroot": pa.array([subroot] * len(rows), pa.string()),
                "root": pa.array([root] * len(rows), pa.string()),
                "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array(folded, pa.string()),
                "verified": pa.array([f == root for f in folded], pa.bool_()),
            })

        fields = ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
        blocked = self.leaves.withColumn("block", F.floor(F.col("pos") / SPAN))
        return blocked.groupBy("g", "block").cogroup(self.block_paths().groupBy("g", "block")).applyInArrow(
            prove,
            f"id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, "
            "folded_root string, verified boolean",
        )


def _leaf_rows(docs: DataFrame, group: str, key: str, own: Column, other: Column | None) -> DataFrame:
    # NULL groups first, the others in the order of their bytes.
    name = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    changed = F.lit(None).cast("string") if other is None else other
    rows = docs.select(name.alias("g"), F.col(key).alias("id"), own.alias("leaf"), changed.alias("other"))
    # Written once: the range sort samples its input first, and texts shall be read and hashed once.
    return stage(rows, "merkle-rows")


def _block_roots(leaves: DataFrame) -> DataFrame:
    def seal(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        frontier = _grown(block["leaf"].to_pylist(), block["total"][0].as_py())
        return pa.table({
            "g": block["g"][:1], "block": block["block"][:1],
            "digest": pa.array([frontier.root], pa.string()), "n": pa.array([len(block)], pa.int64()),
        })

    return (
        leaves.select("g", "pos", "leaf", "total", F.floor(F.col("pos") / SPAN).alias("block"))
        .groupBy("g", "block").applyInArrow(seal, "g string, block long, digest string, n long")
    )


def build(
    docs: DataFrame, own: Column, other: Column | None = None, group: str = "source", key: str = "doc_id"
) -> Manifest:
    """Manifest of ``docs`` with ``own`` as leaf; ``other`` is a second leaf that is to be verified."""
    leaves = stage(
        positions(_leaf_rows(docs, group, key, own, other), ["id", "leaf"]), "merkle-leaves"
    )
    return Manifest(leaves, stage(_block_roots(leaves), "merkle-blocks"))


def append(
    old: Manifest, docs: DataFrame, own: Column, other: Column | None = None,
    group: str = "source", key: str = "doc_id",
) -> Manifest:
    """The manifest with the rows of ``docs`` added; their keys must follow the group's old ones."""
    new = stage(positions(_leaf_rows(docs, group, key, own, other), ["id", "leaf"]), "merkle-new")
    before = old.leaves.groupBy("g").agg(
        F.count(F.lit(1)).alias("__old"), F.max(F.struct("id")).alias("__last")
    )
    added = new.groupBy("g").agg(
        F.count(F.lit(1)).alias("__new"), F.min(F.struct("id")).alias("__first")
    )
    sizes = stage(
        before.join(added, "g", "full").select(
            "g", F.coalesce("__old", F.lit(0)).alias("__old"), F.coalesce("__new", F.lit(0)).alias("__new"),
            F.coalesce(F.col("__first") <= F.col("__last"), F.lit(False)).alias("__mixed"),
        ),
        "merkle-sizes",
    )
    if sizes.filter("__mixed").limit(1).count():
        raise ValueError("appended keys must be greater than the group's keys in the manifest")
    counted = small_or_not(sizes.drop("__mixed"))
    total = F.col("__old") + F.col("__new")
    leaves = stage(
        old.leaves.drop("total").join(counted, "g").withColumn("total", total)
        .unionByName(
            new.drop("total").join(counted, "g").withColumn("total", total)
            .withColumn("pos", F.col("pos") + F.col("__old"))
        ).drop("__old", "__new"),
        "merkle-leaves",
    )
    # What was appended to, or is new: everything from the last full block of the group on.
    sealed = F.floor(F.col("__old") / SPAN)
    kept = old.blocks.filter(F.col("n") == SPAN)
    fresh = leaves.join(counted, "g").filter((F.col("pos") / SPAN) >= sealed).drop("__old", "__new")
    blocks = kept.unionByName(_block_roots(fresh))
    return Manifest(leaves, stage(blocks, "merkle-blocks"))
