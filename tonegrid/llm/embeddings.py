"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned into the axes of the corpus's principal components, largest first. Two
unit vectors with cosine >= t differ by at most sqrt(2 - 2t) on each axis, so slabs of that width on the first axis, and
on the second one too for a label of many vectors, only meet their neighbours; what falls into one is dealt into tiles
of bounded size, and each pair of tiles is one group. Inside it, products
accumulate over the leading axes; the product of the remaining norms bounds what is left, and rows, columns and at last
pairs that cannot reach the threshold drop out. Those left are decided by the cosine of the vectors as given, in double
precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.llm.components import components, local_roots
from tonegrid.operators.lineage import cut

THRESHOLD = 0.98
#: Rows of a tile, and axes that accumulate at a time.
TILE, STEP = 1024, 8
#: Vectors of the most frequent sizes are turned into principal axes, whose squares hold so many numbers at most; those of
#: other sizes are compared along their own axes, which is as exact.
TURNED = 4_000_000
#: Vectors of a label from which the second axis has slabs too.
MANY = 32 * TILE
#: Share of pairs alive under which pairs are decided one by one.
SPARSE = 0.02


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def by_size(column: pa.Array) -> dict[int, np.ndarray]:
    """The places of the lists of each size."""
    sizes = pc.list_value_length(column).to_numpy()
    return {n: np.flatnonzero(sizes == n) for n in np.unique(sizes).tolist()}


def principal_axes(vectors: DataFrame, column: str, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each size: columns are the axes of the scaled vectors, by falling share of their squared length."""

    def run(batches):
        total = {n: np.zeros((n, n)) for n in sizes}
        for batch in batches:
            for n, at in by_size(batch[column]).items():
                x = matrix(batch[column].take(pa.array(at)))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                total[n] += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([x.ravel() for x in total.values()]).tobytes()])], names=["grams"])

    grams = vectors.where(F.size(column).isin(sizes)).select(column).mapInArrow(run, "grams binary")
    total = grams.rdd.map(lambda r: np.frombuffer(r[0])).treeReduce(lambda a, b: a + b)
    cuts = np.cumsum([0, *(n * n for n in sizes)])
    return {n: np.linalg.eigh(total[lo : lo + n * n].reshape(n, n))[1][:, ::-1] for n, lo in zip(sizes, cuts.tolist(), strict=False)}


def reach(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with cosine >= threshold. a, b: in principal axes, unit length; x, y: as given."""
    rows, cols = np.arange(len(a)), np.arange(len(b))
    square = lambda m: np.sqrt(np.maximum(0, np.cumsum((m**2)[:, ::-1], axis=1)[:, ::-1]))  # noqa: E731  norms from each axis on
    rest_a, rest_b = square(a), square(b)
    total = np.zeros((len(a), len(b)))
    size, at = a.shape[1], 0
    alive = np.ones(total.shape, bool)
    while at < size:
        nxt = min(size, at + STEP)
        total += a[rows, at:nxt] @ b[cols, at:nxt].T
        bound = total if nxt == size else total + np.outer(rest_a[rows, nxt], rest_b[cols, nxt])
        alive &= bound >= threshold - 1e-9
        at = nxt
        if not alive.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if alive.mean() < SPARSE:
            break
        r, c = alive.any(axis=1), alive.any(axis=0)
        if r.mean() < 0.7 or c.mean() < 0.7:
            rows, cols, total, alive = rows[r], cols[c], total[np.ix_(r, c)], alive[np.ix_(r, c)]
    i, j = np.nonzero(alive)
    i, j = rows[i], cols[j]
    cosine = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], y[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)])
    cosine /= np.linalg.norm(x, axis=1)[i] * np.linalg.norm(y, axis=1)[j]
    ok = cosine >= threshold
    return i[ok], j[ok]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id: long, embedding: array, label).

    Rows with equal, non-null labels link where the cosine is >= threshold (in double precision). Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of different sizes.
    n_links counts the other rows linked directly, equal vectors included; component_id is the smallest vec_id
    reachable; kept is vec_id = component_id. Equal vectors are compared once.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    fine = F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False))) & F.exists("v", lambda e: e != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    key = [F.xxhash64("label", "v").alias("k1"), F.xxhash64("v", F.lit(1), "label").alias("k2")]
    fields = rows.where("fine").select("vec_id", "label", "v", F.size("v").alias("size"), *key)
    distinct = cut(fields.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("v").alias("v"), F.any_value("size").alias("size")).withColumn("node", F.xxhash64("k1", "k2")))
    linked = cut(_links(distinct, threshold))
    degree = linked.groupBy("node").agg(F.sum("more").alias("more"))
    group = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = distinct.select("k1", "k2", "node", "least", "copies").join(degree, "node", "left").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select("k1", "k2", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    good = rows.where("fine").select("vec_id", *key).join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _links(distinct: DataFrame, threshold: float) -> DataFrame:
    """(node, more: rows linked in one pair of tiles, root: smallest node linked there)."""
    frequent = Window.orderBy(F.desc("count"), "size").rowsBetween(Window.unboundedPreceding, 0)
    counts = distinct.groupBy("size").count().withColumn("held", F.sum(F.col("size").cast("long") * F.col("size")).over(frequent))
    sizes = [r[0] for r in counts.where(F.col("held") <= TURNED).collect()]
    axes = principal_axes(distinct, "v", sizes) if sizes else {}
    width = max(1e-6, math.sqrt(max(0.0, 2 - 2 * threshold))) * (1 + 1e-9) + 1e-9
    two = {n: x[:, :2] for n, x in axes.items()}

    def slab(batches):
        for batch in batches:
            at = np.zeros((len(batch), 2), np.int32)
            for n, rows in by_size(batch["v"]).items():
                x = matrix(batch["v"].take(pa.array(rows)))
                lead = x @ two[n] if n in two else x[:, :2]
                at[rows, : lead.shape[1]] = np.floor(lead / np.linalg.norm(x, axis=1, keepdims=True) / width)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, at.T)], names=[*batch.schema.names, "one", "two"])

    # only vectors of one size meet
    placed = distinct.select("node", "copies", F.xxhash64("label", "size").alias("label"), "v").mapInArrow(slab, "node long, copies long, label long, v array<double>, one int, two int")
    many = placed.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("label", F.lit(True).alias("many"))
    placed = placed.join(many, "label", "left").withColumn("slab", F.struct("one", F.when(F.col("many"), F.col("two")).otherwise(0).alias("two"))).drop("one", "two", "many")
    tiles = placed.groupBy("label", "slab").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    around = F.array(*(F.struct((F.col("slab.one") + i).alias("one"), (F.col("slab.two") + j).alias("two")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    near = tiles.select("label", F.col("tiles").alias("n"), F.explode(around).alias("slab"), F.col("slab").alias("other"))
    near = near.groupBy("label", "slab").agg(F.collect_list(F.struct("other", "n")).alias("near"), F.max(F.when(F.col("slab") == F.col("other"), F.col("n"))).alias("own"))
    spread = placed.join(near.where("own is not null"), ["label", "slab"]).withColumn("tile", F.pmod("node", "own").cast("int"))
    spread = spread.select("node", "copies", "label", "v", "slab", "tile", F.explode("near").alias("o"))
    spread = spread.select("node", "copies", "label", "v", "slab", "tile", F.col("o.other").alias("other"), F.explode(F.sequence(F.lit(0), F.col("o.n") - 1)).alias("other_tile"))
    here, there = F.struct("slab", "tile"), F.struct(F.col("other").alias("slab"), F.col("other_tile").alias("tile"))
    spread = spread.select("node", "copies", "v", "label", F.least(here, there).alias("p"), F.greatest(here, there).alias("q"), (here > there).alias("second"))
    spread = spread.select("node", "copies", "v", "second", "label", F.col("p.slab").alias("s1"), F.col("p.tile").alias("t1"), F.col("q.slab").alias("s2"), F.col("q.tile").alias("t2"))

    def compare(pair: pa.Table) -> pa.Table:
        node, copies, x = pair["node"].to_numpy(), pair["copies"].to_numpy(), matrix(pair["v"])
        y = (x @ axes[x.shape[1]] if x.shape[1] in axes else x) / np.linalg.norm(x, axis=1, keepdims=True)
        second = pair["second"].to_numpy()
        within = (pair["s1"][0].as_py(), pair["t1"][0]) == (pair["s2"][0].as_py(), pair["t2"][0])
        p = np.flatnonzero(~second)
        q = p if within else np.flatnonzero(second)
        i, j = reach(y[p], y[q], x[p], x[q], threshold)
        i, j = p[i], q[j]
        if within:
            i, j = i[i < j], j[i < j]
        more = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
        root = local_roots(len(node), i, j)
        hit = np.flatnonzero(more)
        return pa.table({"node": node[hit], "more": more[hit].astype(np.int64), "root": node[root[hit]]})

    return spread.groupBy("label", "s1", "t1", "s2", "t2").applyInArrow(compare, "node long, more long, root long")
