"""Merkle manifest of a dataset: hash trees kept as blocks in the van Emde Boas layout, proofs and their check.

Every document is a leaf. Aligned runs of ``2**BLOCK_HEIGHT`` leaves of one tree are a block, whose
whole subtree is one binary value; the roots of the blocks are the leaves of the next layer
of blocks, and so on, until one node of the tree is left. A task holds one block at a time, whatever
the number of leaves, and a proof needs one block of every layer.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm import work

BLOCK_HEIGHT = 10
DIGEST = 32  # bytes
ROW_BITS = 33  # of ``monotonically_increasing_id``: the rest is the partition
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LONE, LEFT, RIGHT = 0, 1, 2  # of a node's sibling: there is none, it stands before it, after it

BLOCK = "tree string, block bigint, total bigint, size int, nodes binary, root binary"
LEAF_BLOCK = f"{BLOCK}, doc_ids array<bigint>, claims array<binary>"
PATHS = "tree string, block bigint, path binary, subroot binary, top binary"
PROOFS = (
    "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


# --- the layout ---------------------------------------------------------------


def address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Where nodes of one depth lie in the layout of a full binary tree of ``levels`` levels.

    The tree is cut at half its height: the top tree comes first, then the trees below it
    from left to right, each laid out in the same way.
    """
    place, index = np.zeros(len(index), np.int64), np.asarray(index, np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        depth, levels = depth - upper, levels - upper
        below = index >> depth  # which of the trees below the top one
        place += (1 << upper) - 1 + below * ((1 << levels) - 1)
        index = index & ((1 << depth) - 1)
    return place


@functools.cache
def places(depth: int, levels: int) -> np.ndarray:
    """The address of every node of a depth, from left to right."""
    return address(depth, np.arange(1 << depth), levels)


def height_of(size: int, total: int, height: int) -> int:
    """Levels above the leaves of a block: all of them where the tree goes on above it."""
    return height if total > 1 << height else (size - 1).bit_length()


def parent(*digests: bytes) -> bytes:
    """The hash of a run: of its digests as lowercase hexadecimal text, one after another."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def built(leaves: list[bytes], height: int) -> bytes:
    """The subtree over at most ``2**height`` leaves in the layout; nodes that a last run lacks stay zero."""
    nodes = np.zeros(((2 << height) - 1, DIGEST), np.uint8)
    level = leaves
    for depth in range(height, -1, -1):
        nodes[places(depth, height + 1)[: len(level)]] = np.frombuffer(b"".join(level), np.uint8).reshape(-1, DIGEST)
        if depth:
            level = [parent(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return nodes.tobytes()


def siblings(nodes: bytes, size: int, height: int) -> list[list[tuple[int, bytes]]]:
    """For every leaf, from the leaves up, where its ancestor's sibling stands and its digest."""
    held = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
    found, own, there = [[] for _ in range(size)], np.arange(size), size
    for depth in range(height, 0, -1):
        beside = own ^ 1
        digests = held[places(depth, height + 1)[beside]].tobytes()
        for i, (node, other) in enumerate(zip(own.tolist(), beside.tolist(), strict=True)):
            digest = digests[i * DIGEST : (i + 1) * DIGEST]
            found[i].append((LONE, b"") if other >= there else (LEFT if node & 1 else RIGHT, digest))
        own, there = own >> 1, (there + 1) // 2
    return found


def coded(path: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([side]) + digest for side, digest in path)


def decoded(path: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(path):
        end = at + 1 + (DIGEST if path[at] != LONE else 0)
        out.append((path[at], path[at + 1 : end]))
        at = end
    return out


def folded(digest: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for side, other in path:
        digest = parent(digest) if side == LONE else parent(other, digest) if side == LEFT else parent(digest, other)
    return digest


# --- leaves and their places --------------------------------------------------


def leaf_digest(**changed: Column) -> Column:
    """The digest of a row's fields as hexadecimal text; ``changed`` replaces fields."""

    def field(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, FIELDS)).cast("binary"), 256)


def leaves(docs: DataFrame, claim: Column | None = None) -> DataFrame:
    """(tree, doc_id, digest, claim) per row: the tree is the language, NULL before all, and the claim a digest to check."""
    claim = F.lit(None).cast("string") if claim is None else claim
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(leaf_digest()).alias("digest"),
        F.unhex(claim).alias("claim"),
    )


def positioned(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``position`` from 0 within ``tree`` in the order of ``keys``, and ``total``, the rows of the tree.

    One shuffle, by ranges of tree and keys, so a tree with most of the rows is many ranges. Equal rows
    are told apart by their place in the stored table. Places in a range become positions through the counts
    of the ranges before, which are one row for each range and tree in it.
    """
    spark = rows.sparkSession
    rows = work.written(rows.withColumn("place", F.monotonically_increasing_id()), "leaves")
    order = ["tree", *keys, "place"]
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = work.written(ranged.withColumn("seat", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("seat", ROW_BITS)
    starts = placed.groupBy("tree", part.alias("part")).agg(F.count("*").alias("n"), F.min("seat").alias("first"))
    by_tree = Window.partitionBy("tree")
    before = by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(by_tree))
    joined = placed.withColumn("part", part).join(starts.drop("n"), ["tree", "part"])
    position = F.col("before") + F.col("seat") - F.col("first")
    return joined.withColumn("position", position).drop("place", "seat", "part", "before", "first")


# --- blocks, layer by layer ---------------------------------------------------


def _blocks(height: int, with_claims: bool) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("position")
        digests, size = group.column("digest").to_pylist(), group.num_rows
        total = group.column("total")[0].as_py()
        levels = height_of(size, total, height)
        nodes = built(digests, levels)
        row = {
            "tree": group.column("tree")[0].as_py(),
            "block": group.column("position")[0].as_py() >> height,
            "total": total,
            "size": size,
            "nodes": nodes,
            "root": nodes[:DIGEST],  # the layout begins with the root
        }
        fields = [("tree", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("size", pa.int32()), ("nodes", pa.binary()), ("root", pa.binary())]
        if with_claims:
            row |= {"doc_ids": group.column("doc_id").to_pylist(), "claims": group.column("claim").to_pylist()}
            fields += [("doc_ids", pa.list_(pa.int64())), ("claims", pa.list_(pa.binary()))]
        return pa.Table.from_pylist([row], schema=pa.schema(fields))

    return run


def climbed(nodes: DataFrame, height: int, name: str) -> list[DataFrame]:
    """The layers of blocks over (tree, position, total, digest), lowest first; in the last every tree is one block.

    A layer has ``2**height`` times fewer rows than the one below; the number of layers grows with the logarithm
    of the largest tree. A tree that is whole in a lower layer has no block above it.
    """
    largest = nodes.agg(F.max("total")).first()[0] or 0
    layers, capacity = [], 1 << height
    while True:
        with_claims = "claim" in nodes.columns
        grouped = nodes.withColumn("block", F.shiftright("position", height)).groupBy("tree", "block")
        layers.append(work.written(grouped.applyInArrow(_blocks(height, with_claims), LEAF_BLOCK if with_claims else BLOCK), f"{name}-{len(layers)}"))
        if largest <= capacity:
            return layers
        largest = -(-largest // capacity)
        above = F.expr(f"(total + {capacity - 1}) div {capacity}")
        nodes = layers[-1].where(F.col("total") > capacity).select(
            "tree", F.col("block").alias("position"), above.alias("total"), F.col("root").alias("digest")
        )


def roots(layers: list[DataFrame], height: int) -> DataFrame:
    """(tree, root) of every tree: the root of its only block in the layer where it is whole."""
    whole = [layer.where(F.col("total") <= 1 << height).select("tree", "root") for layer in layers]
    return functools.reduce(DataFrame.unionByName, whole)


def _descended(height: int, last: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a block with the path above it, the paths of its leaves; where ``last``, what their proofs say."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one block at a time
                row = batch.slice(i, 1).to_pylist()[0]
                levels = height_of(row["size"], row["total"], height)
                own = siblings(row["nodes"], row["size"], levels)
                if last:
                    yield from _proved(row, own, levels)
                    continue
                n = row["size"]
                first = row["block"] << height
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * n),
                        pa.array(range(first, first + n), pa.int64()),
                        pa.array([coded(p) + row["path"] for p in own], pa.binary()),
                        pa.array([row["subroot"]] * n, pa.binary()),
                        pa.array([row["top"]] * n, pa.binary()),
                    ],
                    ["tree", "block", "path", "subroot", "top"],
                )

    return run


def _proved(row: dict, own: list[list[tuple[int, bytes]]], levels: int) -> Iterator[pa.RecordBatch]:
    above = decoded(row["path"])
    above_hex = "".join(d.hex() for _, d in above)
    top, held = row["top"].hex(), row["nodes"]
    at = places(levels, levels + 1)
    finish = functools.lru_cache(None)(lambda digest: folded(digest, above).hex())  # the leaves of a block share what is above it
    columns = {name: [] for name in ("leaf", "proof_sha256", "folded_root")}
    for i, path in enumerate(own):
        leaf = held[at[i] * DIGEST : (at[i] + 1) * DIGEST]
        claim = row["claims"][i] or leaf
        columns["leaf"].append(leaf.hex())
        columns["proof_sha256"].append(hashlib.sha256(("".join(d.hex() for _, d in path) + above_hex).encode()).hexdigest())
        columns["folded_root"].append(finish(folded(claim, path)))
    n = len(own)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(row["doc_ids"], pa.int64()),
            pa.array(columns["leaf"]),
            pa.array([row["subroot"].hex()] * n),
            pa.array([top] * n),
            pa.array(columns["proof_sha256"]),
            pa.array(columns["folded_root"]),
            pa.array([f == top for f in columns["folded_root"]]),
        ],
        ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    )


def _down(layers: list[DataFrame], paths: DataFrame, height: int, last: bool) -> DataFrame:
    """The paths of the leaves of the lowest layer (or their proofs), from those of whole trees (tree, path, subroot, top).

    In every layer blocks meet the paths that the layer above gave them; both sides have one row a block.
    """
    given = None
    for k in range(len(layers) - 1, -1, -1):
        whole = layers[k].where(F.col("total") <= 1 << height).join(paths, "tree")
        if given is not None:
            whole = whole.unionByName(layers[k].where(F.col("total") > 1 << height).join(given, ["tree", "block"]))
        lowest = last and k == 0
        given = whole.mapInArrow(_descended(height, lowest), PROOFS if lowest else PATHS)
        if k:
            given = work.written(given, f"paths-{k}")
    return given


@dataclass(frozen=True)
class Manifest:
    """The stored layers of blocks: of the trees of languages, and of the tree over their roots."""

    trees: list[DataFrame]
    tops: list[DataFrame]
    subroots: DataFrame  # tree, position, digest: the leaves of the tree above
    height: int

    def root(self) -> DataFrame:
        """One row with the ``root`` of all; none without documents."""
        return roots(self.tops, self.height).select(F.lower(F.hex("root")).alias("root"))

    def proofs(self) -> DataFrame:
        """One row per document: its leaf, the roots above it, its siblings' digest, and whether its claim gives the root."""
        top = roots(self.tops, self.height).select("tree", F.lit(b"").alias("path"), F.col("root").alias("subroot"), F.col("root").alias("top"))
        above = _down(self.tops, top, self.height, last=False).select(F.col("block").alias("position"), "path", "top")
        paths = self.subroots.join(above, "position").select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "top")
        return _down(self.trees, work.written(paths, "tops"), self.height, last=True)


def manifest(docs: DataFrame, claim: Column | None = None, height: int = BLOCK_HEIGHT) -> Manifest:
    """Builds and stores the trees of ``docs``, one for each language, and the tree over their roots.

    Leaves ascend by document id, a missing one first, equal ids by digest; equal rows are leaves each. Missing
    fields are told from empty texts. Whole texts are read once, in the scan, and only digests
    are shuffled. ``claim`` is a digest per row that proofs are checked with in place of the
    leaf. Other columns are never read. Without rows there are no trees and no root.
    """
    placed = positioned(leaves(docs, claim), ["doc_id", "digest"])
    trees = climbed(work.written(placed, "placed"), height, "blocks")
    named = roots(trees, height).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    subroots = work.written(positioned(named, ["name"]), "subroots")
    tops = climbed(subroots.drop("name"), height, "tops")
    return Manifest(trees, tops, subroots, height)


def tampered() -> Column:
    """The claim of the query: one more character than there is where 7 divides the CRC-32 of the id's digits."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    return F.when(chosen, leaf_digest(n_chars=more))
