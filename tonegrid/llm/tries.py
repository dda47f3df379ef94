"""Prefix tries of conversations by van Emde Boas recursion.

Sequences are cut at half depth, the halves at half of theirs, and so on; all parts of one height are worked on together.
Upwards, the name of a stretch of 2**j turns comes from the names of its halves. Downwards, the prefix that ends at a cut
is named by the prefix before its half and the name of that half: each name is the key of the lower forest under the cut,
so upper trie and lower forests go on side by side. After log2(depth) steps every prefix has its name, with as many
rows in all as there are turns. Totals then go upwards: the totals of a lower forest's roots are grafted on the nodes
of the upper trie above their cut, doubling the height each time.

A node is known by its smallest member and its depth. Conversations are spread by (conversation, place), so neither a
long conversation nor a hot prefix meets in one task; equal names are counted before they are exchanged.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrid.llm._ranks import ranked
from tonegrid.llm._tables import id_crc
from tonegrid.operators.lineage import cut

#: Ends of one node are listed in rows of so many.
ENDS = 1024


def _named(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def rebuild(turns: DataFrame, share: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, length, depth, token, size) of ``turns`` (conv_id long, turn, role, text), a row for each turn of the
    rebuilt conversations and one with depth 0 for each conversation.

    A conversation gets the first h turns of conversation conv_id - conv_id % share (all if it has fewer, none if absent)
    before its own turns after its first h, h being the crc32 of conv_id modulo ``most``. Turns go by ``turn``, null first, and
    those of one number by the digest of role and text, which is the token; size is the text's code points. Null roles and
    texts are empty; rows without conv_id are no conversation; repeated rows are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    token = _named(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", token.alias("token"), F.length(text).cast("long").alias("size"))
    rows = ranked(rows, "conv_id", ["turn", "token"])

    head = F.when(F.col("rank") < most - 1, F.struct("rank", "token", "size"))
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("own"), F.array_sort(F.collect_list(head)).alias("head"))
    convs = convs.select("conv_id", "own", "head", (F.col("conv_id") - F.col("conv_id") % share).alias("base"), (id_crc("conv_id") % most).cast("int").alias("h"))
    bases = convs.where("conv_id = base").select("base", F.col("head").alias("before"))  # at most most - 1 turns each
    convs = convs.drop("head").join(bases, "base", "left").withColumn("before", F.slice(F.coalesce("before", F.array().cast(bases.schema["before"].dataType)), F.lit(1), F.col("h")))
    length = F.size("before") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    convs = cut(convs.select("conv_id", "h", "before", length.cast("long").alias("length")))

    start = convs.select("conv_id", "length", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("token"), F.lit(0).cast("long").alias("size"))
    first = convs.select("conv_id", "length", F.explode("before").alias("x")).select("conv_id", "length", (F.col("x.rank") + 1).alias("depth"), "x.token", "x.size")
    own = rows.join(convs.select("conv_id", "length", "h", F.size("before").alias("shift")), "conv_id").where("rank >= h")
    own = own.select("conv_id", "length", (F.col("rank") - F.col("h") + F.col("shift") + 1).alias("depth"), "token", "size")
    return start.unionByName(first).unionByName(own)


def _prefixes(sequences: DataFrame, levels: int) -> DataFrame:
    """(conv_id, depth, name, size, ends) of every prefix that has turns."""
    stretch = sequences.where("depth > 0").select("conv_id", (F.col("depth") - 1).alias("block"), F.col("token").alias("name"), "size", (F.col("depth") == F.col("length")).alias("ends"))
    stretches = [cut(stretch)]
    for _ in range(levels - 1):
        left, right = F.col("block") % 2 == 0, F.col("block") % 2 == 1
        pair = stretches[-1].groupBy("conv_id", F.shiftright("block", 1).alias("half")).agg(
            F.max(F.when(left, F.col("name"))).alias("one"), F.max(F.when(right, F.col("name"))).alias("two"),
            F.max(F.when(right, F.col("size"))).alias("size"), F.max(F.when(right, F.col("ends"))).alias("ends"),
        ).where("two IS NOT NULL")
        stretches.append(cut(pair.select("conv_id", F.col("half").alias("block"), _named(F.col("one"), F.col("two")).alias("name"), "size", "ends")))
    known = sequences.where("depth = 0 AND length > 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("name"), "size", F.lit(False).alias("ends"))
    for j in reversed(range(levels)):
        half = stretches[j].select("conv_id", F.shiftleft("block", j).alias("depth"), F.col("name").alias("half"), F.col("size").alias("last"), F.col("ends").alias("over")).where((F.col("block") % 2) == 0)
        cuts = known.join(half, ["conv_id", "depth"])
        cuts = cuts.select("conv_id", (F.col("depth") + (1 << j)).alias("depth"), _named(F.col("name"), F.col("half")).alias("name"), F.col("last").alias("size"), F.col("over").alias("ends"))
        known = known.unionByName(cut(cuts))
    return known.where("depth > 0")


def _grafted(nodes: DataFrame, owners: DataFrame, rounds: int) -> DataFrame:
    """nodes (conv_id, depth, parent_conv_id, n_leaves, saved_tokens of their own) with totals of their subtrees."""
    for j in range(rounds):
        height = 1 << j
        roots = nodes.where(F.pmod(F.col("depth") - 1, F.lit(2 * height)) == height)
        at_cut = roots.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("cut")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        above = at_cut.select("conv_id", F.explode(F.sequence(F.col("cut") - (height - 1), F.col("cut"))).alias("depth"), "n_leaves", "saved_tokens")
        grafts = above.join(owners, ["conv_id", "depth"]).select(F.col("owner").alias("conv_id"), "depth", "n_leaves", "saved_tokens")
        both = nodes.unionByName(grafts, allowMissingColumns=True)
        nodes = cut(both.groupBy("conv_id", "depth").agg(F.max("parent_conv_id").alias("parent_conv_id"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    return nodes


def _digests(batches):
    """Of rows sorted by node and chunk, the digest of each node's joined pieces; one piece is held at a time."""
    now, digest = None, None
    for batch in batches:
        nodes, out = [], []
        for node, piece in zip(batch.column("node").to_pylist(), batch.column("piece"), strict=True):
            if node == now:
                digest.update(b",")
            else:
                if now is not None:
                    nodes.append(now)
                    out.append(digest.hexdigest())
                now, digest = node, hashlib.sha256()
            digest.update(piece.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(out, pa.string())], names=["node", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of ``ends`` (conv_id, depth, end): the digest of a node's ends in decimal, ascending,
    comma-joined. Ends are ranked and listed by pieces, and the pieces of a node pass through its digest one after another."""
    rows = ends.select(F.concat_ws(":", "conv_id", "depth").alias("node"), "end")
    pieces = ranked(rows, "node", ["end"]).groupBy("node", F.floor(F.col("rank") / ENDS).alias("chunk")).agg(F.sort_array(F.collect_list("end")).alias("some"))
    pieces = pieces.select("node", "chunk", F.array_join(F.transform("some", lambda x: x.cast("string")), ",").alias("piece"))
    done = pieces.repartition("node").sortWithinPartitions("node", "chunk").select("node", "piece").mapInArrow(_digests, "node string, ends_sha256 string")
    node = F.split("node", ":")
    return done.select(node[0].cast("long").alias("conv_id"), node[1].cast("long").alias("depth"), "ends_sha256")


def build_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of ``sequences`` (conv_id, length, depth, token: binary, size; as ``rebuild`` gives them): conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Every distinct sequence of first d tokens is a node, the root (d = 0) too; conversations that start with it are members.
    n_leaves counts the childless nodes of a subtree, saved_tokens adds (n_convs - 1) times the last token's size over it,
    ends_sha256 is the digest of the members of d turns. No conversation: no node, not even a root.
    """
    sequences = cut(sequences)
    n_convs, least, deepest = sequences.where("depth = 0").agg(F.count("*"), F.min("conv_id"), F.max("length")).first()
    levels = max(1, (deepest or 0).bit_length())
    prefixes = cut(_prefixes(sequences, levels))
    named = prefixes.groupBy("name").agg(F.min("conv_id").alias("owner"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("size").alias("size"))
    named = cut(named)
    owners = cut(prefixes.join(named.select("name", "owner"), "name").select("conv_id", "depth", "owner", "ends"))

    parents = owners.select(F.col("conv_id").alias("owner"), (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent_conv_id"))
    nodes = named.join(parents, ["owner", "depth"], "left").select(F.col("owner").alias("conv_id"), "depth", F.coalesce("parent_conv_id", F.lit(least)).alias("parent_conv_id"), "n_convs", "size")
    nodes = cut(nodes)
    children = nodes.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    whole = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    whole = cut(whole)
    own = whole.select("conv_id", "depth", "parent_conv_id", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    totals = _grafted(own, owners.select("conv_id", "depth", "owner"), max(0, (deepest or 1) - 1).bit_length()).drop("parent_conv_id")
    whole = whole.join(totals, ["conv_id", "depth"]).drop("size")

    tops = whole.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    root = tops.select(
        F.lit(least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n_convs).cast("long").alias("n_convs"),
        "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens",
    ).where(F.lit(n_convs > 0))
    turnless = sequences.where("depth = 0 AND length = 0").select(F.lit(least).cast("long").alias("conv_id"), "depth", F.col("conv_id").alias("end"))
    ends = owners.where("ends").select(F.col("owner").alias("conv_id"), "depth", F.col("conv_id").alias("end")).unionByName(turnless)
    out = whole.unionByName(root).join(end_digests(ends), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256")
    )
