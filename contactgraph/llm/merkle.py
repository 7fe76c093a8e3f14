"""Merkle manifest of a dataset, with a proof for every row.

The leaves of each tree are in order, and every two consecutive nodes become one
until a single node, the subroot, is left; the subroots in order of their trees
become the root likewise. The work is dealt by superblocks, aligned runs of
``2**height`` leaves. A first pass reduces every superblock to its top node; these
nodes are far fewer and are proven by the same procedure among themselves. Then
the leaves and the outer nodes that their superblock requires are cogrouped, and one
``applyInPandas`` finishes the local reduction, joins local and outer proof and
folds every leaf up to the root.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactgraph.functions.joins import hot_join
from contactgraph.functions.ordering import dense_index
from contactgraph.session import cut_lineage, fresh_folder

#: Levels of a superblock.
HEIGHT = 10
#: Where the sibling stands; a node without one is hashed alone.
LEFT, RIGHT, ALONE = "L", "R", "-"


def leaf_digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields: each ``-`` if null, else the length of
    its UTF-8 text in bytes, a colon and the text."""
    told = []
    for field in fields:
        text = field.cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*told).cast("binary"), 256)


# hashing of nodes: each is its raw digest and the hex text that enters the next


def _node(text: bytes) -> tuple[bytes, bytes]:
    raw = sha256(text).digest()
    return raw, raw.hex().encode()


def _reduced(nodes: list[tuple[bytes, bytes]], levels: int) -> list[list[tuple[bytes, bytes]]]:
    """The nodes, and those of each of ``levels`` levels above them."""
    found = [nodes]
    for _ in range(levels):
        below = found[-1]
        found.append([_node(b"".join(n[1] for n in below[i : i + 2])) for i in range(0, len(below), 2)])
    return found


def _levels(size: int, height: int) -> int:
    """Levels that a superblock of a tree of ``size`` nodes is reduced by: all of its
    own, or those of the tree if it is the only one."""
    return min(height, (size - 1).bit_length())


def _path(levels: list, place: int) -> list[tuple[str, tuple[bytes, bytes] | None]]:
    """Side and sibling at each level from the node at ``place`` to the top."""
    steps = []
    for nodes in levels[:-1]:
        other = place ^ 1
        if other < len(nodes):
            steps.append((LEFT if place & 1 else RIGHT, nodes[other]))
        else:
            steps.append((ALONE, None))
        place >>= 1
    return steps


def fold(leaf: bytes, sides: str, proof: bytes) -> bytes:
    """The root that a leaf and its proof lead to, all as raw digests."""
    node, at = leaf.hex().encode(), 0
    raw = leaf
    for side in sides:
        other = b""
        if side != ALONE:
            other = proof[at : at + 32].hex().encode()
            at += 32
        raw, node = _node(other + node if side == LEFT else node + other)
    return raw


def _told(steps) -> tuple[str, bytes]:
    return "".join(side for side, _ in steps), b"".join(node[0] for _, node in steps if node is not None)


def _both(raw: bytes) -> tuple[bytes, bytes]:
    return bytes(raw), bytes(raw).hex().encode()


# trees on Spark


_NODES = "tree string, pos bigint, size bigint, digest binary"
_PROVEN = "tree string, pos bigint, sides string, proof binary, top binary"


def _blocked(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", height))


def _tops(nodes: DataFrame, height: int) -> DataFrame:
    """The top node of each superblock, as nodes of a smaller tree."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        tree, at, size = block["tree"].iloc[0], int(block["block"].iloc[0]), int(block["size"].iloc[0])
        top = _reduced([_both(d) for d in block["digest"]], _levels(size, height))[-1]
        assert len(top) == 1
        return pd.DataFrame({"tree": [tree], "pos": [at], "size": [-(-size >> height)], "digest": [top[0][0]]})

    rows = _blocked(nodes, height).select("tree", "block", "pos", "size", "digest")
    return rows.groupBy("tree", "block").applyInPandas(run, _NODES)


def _outer(nodes: DataFrame, largest: int, height: int) -> DataFrame:
    """``(tree, block, sides, proof, top)``: what lies between each superblock's top
    node and the top of its tree. ``largest`` is the size of the largest tree."""
    tops = cut_lineage(_tops(nodes, height))
    proven = _proven(tops, -(-largest >> height), height)
    return proven.withColumnRenamed("pos", "block")


def _proven(nodes: DataFrame, largest: int, height: int) -> DataFrame:
    """``(tree, pos, sides, proof, top)`` for all nodes of all trees."""

    def local(block: pd.DataFrame, outer_sides: str, outer_proof: bytes, outer_top: bytes | None) -> pd.DataFrame:
        block = block.sort_values("pos")
        levels = _reduced([_both(d) for d in block["digest"]], _levels(int(block["size"].iloc[0]), height))
        told = [_told(_path(levels, place)) for place in range(len(block))]
        return pd.DataFrame(
            {
                "tree": block["tree"],
                "pos": block["pos"],
                "sides": [sides + outer_sides for sides, _ in told],
                "proof": [proof + outer_proof for _, proof in told],
                "top": levels[-1][0][0] if outer_top is None else outer_top,
            }
        )

    rows = _blocked(nodes, height)
    if largest <= 1 << height:
        return rows.groupBy("tree", "block").applyInPandas(lambda block: local(block, "", b"", None), _PROVEN)

    def joined(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        return local(block, outer["sides"].iloc[0], bytes(outer["proof"].iloc[0]), bytes(outer["top"].iloc[0]))

    outer = _outer(nodes, largest, height)
    return rows.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(joined, _PROVEN)


def _placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``pos``, from 0 within each tree, and ``size``, the tree's.

    Rows are range-partitioned and sorted; the number of a tree's rows in the
    partitions before (a row per partition and tree) is added. Equal rows are
    told apart by their place in the input, so a crowd of them is split too.
    """
    order = ["tree", "known", "id", "leaf", "salt"]
    kept = cut_lineage(leaves.withColumn("salt", F.monotonically_increasing_id()))
    placed = cut_lineage(
        kept.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt").withColumn("slot", F.monotonically_increasing_id())
    ).withColumn("range", F.shiftright("slot", 33))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("range", "tree").agg(F.min("slot").alias("first"), F.count("*").alias("n")).select(
        "range", "tree", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(whole).alias("size")
    )
    # written and read again, so that its size is known where it is joined
    path = fresh_folder(leaves.sparkSession, "merkle-runs")
    runs.write.parquet(path)
    runs = leaves.sparkSession.read.parquet(path)
    return placed.join(runs, ["range", "tree"]).withColumn("pos", F.col("base") + F.col("slot") - F.col("first")).drop(
        "range", "slot", "first", "base"
    )


_OUT = (
    "tree string, known boolean, id bigint, leaf binary, subroot binary, root binary, "
    "sides string, proof binary, folded binary"
)


def _as_hex(name: str) -> Column:
    return F.lower(F.hex(name))


def prove(
    docs: DataFrame,
    leaf: Column,
    again: Column | None = None,
    id_col: str = "doc_id",
    tree_col: str = "lang",
    height: int = HEIGHT,
) -> DataFrame:
    """``(id, tree, leaf, subroot, root, sides, proof, folded_root, verified)`` per row.

    ``leaf`` is the hex digest of a row, see :func:`leaf_digest`; ``again`` is the
    digest found at a later look, null where nothing has changed. The rows of a tree
    stand in order of their id, null ids first, then of their digests; trees in
    order of their names, null first. ``proof`` holds the raw digests of the
    siblings from the leaf to the root, ``sides`` says for each level on which side
    the sibling stands (``-``: there is none). ``folded_root`` is what ``again``, else
    the leaf, and the proof lead to, and ``verified`` whether it is the root.

    Repeated rows are leaves of their own, each with its own proof; null and empty
    texts differ by their digests; an empty table has no rows. A tree of any share
    of the rows is dealt by superblocks, no task holds more than one. Runs jobs.
    """
    if height < 1:
        raise ValueError(f"height must be positive, got {height}")
    number = F.col(id_col).cast("bigint")
    leaves = docs.select(
        # in order of bytes: null first
        F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit("")).alias("tree"),
        # pandas has no null among whole numbers
        number.isNotNull().alias("known"),
        F.coalesce(number, F.lit(0)).alias("id"),
        F.unhex(leaf).alias("leaf"),
        F.unhex(F.lit(None).cast("string") if again is None else again).alias("again"),
    )
    placed = _placed(leaves)
    nodes = placed.select("tree", "pos", "size", F.col("leaf").alias("digest"))
    largest = placed.agg(F.max("size")).first()[0] or 0

    inner = cut_lineage(_outer(nodes, largest, height))
    subroots = dense_index(inner.filter("block = 0").select("tree", F.col("top").alias("digest")), "tree")
    count = subroots.count()
    listed = subroots.select(
        F.lit("").alias("tree"), (F.col("idx") - 1).alias("pos"), F.lit(count).cast("bigint").alias("size"), "digest"
    )
    above = _proven(listed, count, height).select(
        (F.col("pos") + 1).alias("idx"), F.col("sides").alias("up_sides"), F.col("proof").alias("up_proof"), F.col("top").alias("root")
    )
    named = above.join(subroots.select("idx", "tree"), "idx").drop("idx")
    required = hot_join(inner, named, "tree").select(
        "tree",
        "block",
        F.concat("sides", "up_sides").alias("sides"),
        F.concat("proof", "up_proof").alias("proof"),
        F.col("top").alias("subroot"),
        "root",
    )

    def run(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        sides, proof, subroot, root = (outer[c].iloc[0] for c in ("sides", "proof", "subroot", "root"))
        proof = bytes(proof)
        levels = _reduced([_both(d) for d in block["leaf"]], _levels(int(block["size"].iloc[0]), height))
        told = [_told(_path(levels, place)) for place in range(len(block))]
        told = [(s + sides, p + proof) for s, p in told]
        seen = [leaf if new is None else new for leaf, new in zip(block["leaf"], block["again"])]
        return pd.DataFrame(
            {
                "tree": block["tree"],
                "known": block["known"],
                "id": block["id"],
                "leaf": block["leaf"],
                "subroot": bytes(subroot),
                "root": bytes(root),
                "sides": [s for s, _ in told],
                "proof": [p for _, p in told],
                "folded": [fold(bytes(leaf), s, p) for leaf, (s, p) in zip(seen, told)],
            }
        )

    found = _blocked(placed, height).groupBy("tree", "block").cogroup(required.groupBy("tree", "block")).applyInPandas(run, _OUT)
    return found.select(
        F.when(F.col("known"), F.col("id")).alias("id"),
        F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias("tree"),
        *[_as_hex(c).alias(c) for c in ("leaf", "subroot", "root")],
        "sides",
        "proof",
        _as_hex("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
