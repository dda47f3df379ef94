"""A Merkle manifest of a table: every row is a leaf, every group of rows a binary tree, and the groups' roots one more.

Nested-struct rollup: a row's rank in its group is written in binary digits. Within blocks of 2**SPAN consecutive ranks
the digits are grouped away from the last one on; each step nests the (one or two) children in their parent's struct, all
steps in the partitions of one exchange by block. The blocks' roots are rows of the next round, until a group is one row.
Downwards, a block meets the path above it by its key in one grouping, transforms turn nested structs into leaves with
their paths, and an explode emits them; nothing is joined to find a sibling.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrid.llm._ranks import ranked
from tonegrid.operators.lineage import cut

#: A block nests at most 2**SPAN rows.
SPAN = 8

_ADDED = ("leaf", "subroot", "root", "proof")
_NO_STEPS = "array<struct<side: string, hash: string>>"


def digest(text: Column) -> Column:
    """Lowercase hex of the SHA-256 of a string in UTF-8."""
    return F.sha2(text, 256)


def leaf_digest(columns: list[Column]) -> Column:
    """The digest of values, each as its UTF-8 byte count, ``:`` and the value, or ``-`` if null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return digest(F.concat(*parts))


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the steps of its proof give."""

    def step(h: Column, s: Column) -> Column:
        left, right = F.when(s["side"] == "left", s["hash"]), F.when(s["side"] == "right", s["hash"])
        return digest(F.concat(F.coalesce(left, F.lit("")), h, F.coalesce(right, F.lit(""))))

    return F.aggregate(proof, leaf, step)


def _nodes(level: int) -> Column:
    """How many nodes the row's group has so many levels above its n rows."""
    return F.shiftright(F.col("n") + ((1 << level) - 1), level)


def _fold(rows: DataFrame, depth: int) -> DataFrame:
    """(grp, block, n, node) from (grp, rank, n, h, own): node is a block's top, depth levels up, its children nested in it."""
    digit = lambda j: f"d{j}"
    digits = [F.shiftright("rank", j).bitwiseAND(1).cast("int").alias(digit(j)) for j in reversed(range(depth))]
    frame = rows.select("grp", F.shiftright("rank", depth).alias("block"), "n", *digits, F.struct("h", "own").alias("node")).repartition("grp", "block")
    for j in range(depth):
        child = lambda d, j=j: F.first(F.when(F.col(digit(j)) == d, F.col("node")), ignorenulls=True)
        frame = frame.groupBy("grp", "block", "n", *(digit(i) for i in reversed(range(j + 1, depth)))).agg(child(0).alias("l"), child(1).alias("r"))
        left, right = F.col("l")["h"], F.col("r")["h"]
        h = F.when(_nodes(j) == 1, left).otherwise(digest(F.concat(left, F.coalesce(right, F.lit("")))))
        kids = F.when(F.col("r").isNull(), F.array("l")).otherwise(F.array("l", "r"))  # an array: two struct columns would double the schema each time
        frame = frame.withColumn("node", F.struct(h.alias("h"), kids.alias("kids"))).drop("l", "r")
    return frame


def _below(level: int) -> Callable[[Column], Column]:
    """From a node at level + 1 with its path to its children with theirs."""

    def step(side: str, other: Column) -> Column:
        return F.array(F.struct(F.when(other.isNotNull(), F.lit(side)).alias("side"), other["h"].alias("hash")))

    def below(x: Column) -> Column:
        kids = x["node"]["kids"]
        one, two = F.get(kids, 0), F.get(kids, 1)
        alone = F.struct(one.alias("node"), F.when(_nodes(level) == 1, x["path"]).otherwise(F.concat(step("right", two), x["path"])).alias("path"))
        second = F.struct(two.alias("node"), F.concat(step("left", one), x["path"]).alias("path"))
        return F.when(two.isNull(), F.array(alone)).otherwise(F.array(alone, second))

    return below


def _unfold(blocks: DataFrame, depth: int) -> DataFrame:
    """(own, h, path, subroot, root), a row for each that went into (grp, block, n, node, path, subroot, root)."""
    current = F.array(F.struct("node", "path"))
    for j in reversed(range(depth)):
        current = F.flatten(F.transform(current, _below(j)))
    out = blocks.select(F.explode(current).alias("x"), "subroot", "root")
    return out.select(F.col("x.node.own").alias("own"), F.col("x.node.h").alias("h"), F.col("x.path").alias("path"), "subroot", "root")


def _rounds(rows: DataFrame) -> list[tuple[DataFrame, int]]:
    """Blocks of (grp, rank, n, h, own) and their depth, then blocks of their roots, and so on until each group is one block."""
    out: list[tuple[DataFrame, int]] = []
    most = rows.agg(F.max("n")).first()[0] or 1
    while most > 1 or not out:
        depth = min(SPAN, (most - 1).bit_length())
        blocks = cut(_fold(rows, depth))
        out.append((blocks, depth))
        rows = blocks.select("grp", F.col("block").alias("rank"), _nodes(depth).alias("n"), F.col("node.h").alias("h"), F.struct("grp", "block").alias("own"))
        most = (most + (1 << depth) - 1) >> depth
    return out


def _under(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks beside the path above them, by key: both sides have one row for each."""
    both = blocks.unionByName(above.select("own.*", "path", "subroot", "root"), allowMissingColumns=True)
    return both.groupBy("grp", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("n", "node", "path", "subroot", "root")))


def _descend(rounds: list[tuple[DataFrame, int]], top: DataFrame) -> DataFrame:
    """The rows of the first round with their paths; top: the last round with path, subroot and root."""
    rows = _unfold(top, rounds[-1][1])
    for blocks, depth in reversed(rounds[:-1]):
        rows = _unfold(_under(blocks, rows), depth)
    return rows


def build_manifest(docs: DataFrame, fields: list[str], group: str, order: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with leaf, subroot, root (hex) and proof, an array of steps (side, hash) from the leaf
    to the root: the sibling's digest and whether it stands left or right; both are null where a node has none.

    A leaf is the digest of a row's ``fields``. In each group leaves ascend by ``order`` (nulls first, then by digest);
    every two consecutive nodes become their digest until one is left, the subroot; an odd last one is hashed alone. The
    subroots of the groups, by group (null first, then by UTF-8 bytes), give the root alike. A null group is a group. Rows that
    repeat are leaves of their own; of rows equal in order and digest, any one comes first. An empty table gives no rows.
    Clashing names: the added columns win.
    """
    keep = [c for c in keep if c not in _ADDED]
    own = F.struct(*(F.col(c) for c in keep)) if keep else F.struct(F.lit(0).alias("_"))
    rows = docs.select(F.col(group).cast("string").alias("grp"), F.col(order).alias("key"), leaf_digest([F.col(c) for c in fields]).alias("h"), own.alias("own"))
    rows = ranked(rows, "grp", ["key", "h"])
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n")).withColumnRenamed("grp", "of")
    rows = rows.join(sizes, F.col("grp").eqNullSafe(F.col("of"))).select("grp", "rank", "n", "h", "own")
    rounds = _rounds(rows)

    subroots = rounds[-1][0].select(F.lit(0).alias("grp"), F.col("grp").alias("key"), F.col("node.h").alias("h"), F.struct("grp", "block").alias("own"))
    groups = ranked(subroots, "grp", ["key"])
    groups = groups.select("grp", "rank", F.lit(groups.count()).cast("long").alias("n"), "h", "own")
    upper = _rounds(groups)
    root = F.col("node.h")
    top = upper[-1][0].withColumns({"path": F.array().cast(_NO_STEPS), "subroot": F.lit(None).cast("string"), "root": root})
    roots = _descend(upper, top).withColumn("subroot", F.col("h"))
    last = _under(rounds[-1][0], roots)
    leaves = _descend(rounds, last)
    return leaves.select(*(F.col("own")[c].alias(c) for c in keep), F.col("h").alias("leaf"), "subroot", "root", F.col("path").alias("proof"))
