"""Numbers on vectors: reduction, exact neighbours, clusters, placement, and a layout of the neighbour graph."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tonegrid.operators.lineage import cut

#: Rows of a block of the neighbour search.
BLOCK_ROWS = 4096
#: Pivots of the neighbour search, at most: of all rows, and of the rows of a large cell.
CELLS = 1024
#: Rows that are held against the pivots of a large cell at a time.
SLICE_ROWS = 1024
#: Queries that are held against a leaf at a time.
TILE_ROWS = 512
#: Blocks of the neighbour search in a shelf, and leaves of a split cell that share one.
SHELF_BLOCKS, SHELF_LEAVES = 4, 16
NEIGHBOURS = 15
#: Rounds that draw candidates for the first centres of k-means.
SEED_ROUNDS = 3
#: Nodes that a graph is contracted to for its layout, at most; their matrix is the driver's.
COARSE_NODES = 1024
#: Axes that the layout brings along, so that its two settle whatever lies close behind them.
AXES = 8


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = pa.chunked_array([column]) if isinstance(column, pa.Array) else column
    flat = flat.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def gram(vectors: DataFrame, vec: str = "vec") -> np.ndarray:
    """The d x d sum of outer products: one partial sum per task, added up in a tree."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = _matrix(b[vec])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"g": [total.tobytes()]})

    parts = vectors.select(vec).mapInArrow(run, "g binary").rdd.map(lambda r: np.frombuffer(r[0]))
    both = lambda a, b: b if a is None else a if b is None else a + b
    total = parts.treeAggregate(None, both, both)
    return np.zeros((0, 0)) if total is None else total.reshape(math.isqrt(len(total)), -1)


def reduce_dims(vectors: DataFrame, k: int = 50) -> tuple[DataFrame, np.ndarray | None]:
    """(row_idx, vec) on the k leading axes of the uncentred Gram matrix, and the basis (d x k).

    No more than k columns stay as they are, without a basis. An axis points where its largest entry is positive.
    """
    g = gram(vectors)
    if len(g) <= k:
        return vectors, None
    basis = np.linalg.eigh(g)[1][:, ::-1][:, :k]
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(k)])
    return project(vectors, basis), basis


def project(vectors: DataFrame, basis: np.ndarray) -> DataFrame:
    """(row_idx, vec) times the basis; a vector of another width is an error."""

    def run(batches):
        for b in batches:
            y = _matrix(b["vec"]) @ basis if b.num_rows else np.zeros((0, basis.shape[1]))
            yield pa.RecordBatch.from_pydict({"row_idx": b["row_idx"].cast(pa.int64()), "vec": pa.array(list(y), pa.list_(pa.float64()))})

    return vectors.select("row_idx", "vec").mapInArrow(run, "row_idx long, vec array<double>")


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = 5, target: str | None = None, block_rows: int = BLOCK_ROWS, cells: int = CELLS) -> DataFrame:
    """(query, row_idx, distance, rank): the k exact nearest rows of each query, lower rows first on ties.

    Queries (row_idx, vec) default to all rows; a row is never its own neighbour. With ``target`` (a column of both),
    only rows whose value differs from the query's count. Vectors with a non-finite component neither ask nor answer.

    Rows belong to the cell of their nearest pivot, and in a cell of over ``block_rows`` rows to that of its own nearest
    pivot. A query is answered in its own leaf first; its k-th distance there bounds what it needs, so it then goes only
    to shelves (leaves of 4 * ``block_rows`` rows or so together) where a pivot and radius leave room within that, once
    to each; there it is held against the leaves within its bound. What is over a shelf's rows is dealt into blocks. Of
    equal vectors (and target) only the k + 1 lowest rows can be answers, and where most queries are equal they ask once.
    The pivots, counts and radii of the first level, ``cells`` (CELLS or fewer) at most, are what reaches the driver;
    those of the second stay tables. Tasks hold a shelf and TILE_ROWS queries' distances to a leaf, whatever the table.
    """
    queries = vectors if queries is None else queries
    fine = F.forall("vec", lambda x: F.abs(x.cast("double")) < float("inf"))
    extra = [target] if target else []
    rows, asked = vectors.where(fine).select("row_idx", "vec", *extra), queries.where(fine).select("row_idx", "vec", *extra)
    copies = Window.partitionBy(F.xxhash64("vec", *extra), "vec", *extra).orderBy("row_idx")
    rows = cut(rows.withColumn("__c", F.row_number().over(copies)).where(F.col("__c") <= k + 1).drop("__c"))
    several, different = asked.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("vec", *extra))).first()
    if several <= max(block_rows, 2 * different):
        return _ranked(_found(rows, asked, k, target, block_rows, cells, True), k)
    classes = cut(asked.groupBy("vec", *extra).agg(F.min("row_idx").alias("row_idx")).select("row_idx", "vec", *extra))
    ranked = _ranked(_found(rows, classes, k + 1, target, block_rows, cells, False), k + 1)
    hits = ranked.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "row_idx", "distance"))).alias("h"))  # k + 1 entries each
    one = asked.select(F.col("row_idx").alias("query"), "vec", *extra)
    named = classes.select(F.col("row_idx").alias("__one"), F.col("vec").alias("__v"), *(F.col(c).alias("__t") for c in extra))
    same = (F.col("vec") == F.col("__v")) & F.col(target).eqNullSafe(F.col("__t")) if target else F.col("vec") == F.col("__v")
    met = one.join(named, same).select("query", "__one").join(hits.withColumnRenamed("query", "__one"), "__one")
    left = F.slice(F.filter("h", lambda x: x["row_idx"] != F.col("query")), 1, k)
    return met.select("query", F.posexplode(left).alias("p", "x")).select("query", "x.row_idx", "x.distance", (F.col("p") + 1).alias("rank"))


def _found(rows: DataFrame, asked: DataFrame, k: int, target: str | None, block_rows: int, cells: int, apart: bool) -> DataFrame:
    """(query, row_idx, distance): the k nearest rows of each query and others; with ``apart``, none of its own number."""
    extra = [target] if target else []
    n = rows.count()
    if n <= block_rows:
        whole = lambda f: f.withColumns({"shelf": F.lit(0), "leaf": F.lit(0)})
        asked, rows = whole(asked).withColumn("bound", F.lit(None).cast("double")), whole(rows)
        return _compared(asked, rows, k, target, block_rows, apart, True)
    drawn = rows.orderBy(F.xxhash64("row_idx"), "row_idx").limit(min(cells, -(-n // block_rows) * 4)).collect()
    pivots = np.array([r["vec"] for r in drawn], np.float64)
    rows, asked = (cut(_in_cells(f, pivots, extra)) for f in (rows, asked))
    first = {r[0]: (r[1], r[2]) for r in rows.groupBy("cell").agg(F.count("*"), F.max("away")).collect()}
    large = {c: m for c, (m, _) in first.items() if m > block_rows}
    inner = _inner_pivots(rows, large, block_rows) if large else None
    split = sorted(r[0] for r in inner.select("cell").distinct().collect()) if large else []  # CELLS at most
    rows, asked = (cut(_in_leaves(f, inner, split, extra)) for f in (rows, asked)) if split else (_in_leaves(f, inner, split, extra) for f in (rows, asked))
    own = asked.withColumns({"shelf": F.col("leaf"), "bound": F.lit(None).cast("double")})
    home = cut(_ranked(_compared(own, rows.withColumn("shelf", F.col("leaf")), k, target, block_rows, apart, True), k).drop("rank"))
    bound = home.groupBy("query").agg(F.when(F.count("*") >= k, F.max("distance")).alias("bound"))
    shelves = _shelves({c: m for c, (m, _) in first.items() if c not in set(split)}, SHELF_BLOCKS * block_rows)
    abroad = _visits(asked.join(bound.withColumnRenamed("query", "row_idx"), "row_idx", "left"), pivots, {c: r for c, (_, r) in first.items()}, split, shelves, extra)
    if split:
        abroad = _inner_visits(cut(abroad), rows, inner, split, extra)
    abroad = abroad.select("row_idx", "vec", *extra, "bound", "leaf", "shelf")
    number = F.create_map(*(F.lit(x) for pair in shelves.items() for x in pair)) if shelves else None
    there = F.when(F.col("cell").isin(split), F.col("leaf") - F.pmod("leaf", F.lit(SHELF_LEAVES))) if split else F.lit(None).cast("int")
    rows = rows.withColumn("shelf", there if number is None else F.coalesce(there, number[F.col("cell")]))
    return home.unionByName(_compared(cut(abroad), rows, k, target, SHELF_BLOCKS * block_rows, apart, False))


def _shelves(sizes: dict[int, int], most: int) -> dict[int, int]:
    """The shelf of each whole cell (cell: rows): cells that follow each other, of ``most`` rows together; a shelf has the
    leaf number of its first cell."""
    out, held, at = {}, 0, None
    for c in sorted(sizes):
        if at is None or held + sizes[c] > most:
            held, at = 0, c * CELLS
        out[c], held = at, held + sizes[c]
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "row_idx"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "row_idx", "distance", "rank")


def _apart(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances from each row to each pivot."""
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T, 0))


def _in_cells(frame: DataFrame, pivots: np.ndarray, extra: list[str]) -> DataFrame:
    """Rows with the cell of their nearest pivot, and how far away that is."""

    def run(batches):
        for b in batches:
            d = _apart(_matrix(b["vec"]), pivots) if b.num_rows else np.zeros((0, len(pivots)))
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=[*b.schema.names, "cell", "away"])

    fields = {f.name: f.dataType.simpleString() for f in frame.schema}
    return frame.mapInArrow(run, ", ".join(f"`{c}` {fields[c]}" for c in ("row_idx", "vec", *extra)) + ", cell int, away double")


def _inner_pivots(rows: DataFrame, large: dict[int, int], block_rows: int) -> DataFrame:
    """(cell, at, vec): pivots of large cells (cell: rows), drawn from their rows, numbered from 0."""
    wanted = [(c, m, min(CELLS, -(-m // block_rows) * 4)) for c, m in large.items()]
    sizes = rows.sparkSession.createDataFrame(wanted, "cell int, m long, wanted int")
    drawn = F.xxhash64(F.lit(5), "row_idx")
    # some two times as many as wanted are ordered, not a whole cell
    some = rows.join(F.broadcast(sizes), "cell").where(F.pmod(drawn, F.ceil(F.col("m") / (2 * F.col("wanted")))) == 0)
    at = F.row_number().over(Window.partitionBy("cell").orderBy(drawn, "row_idx")) - 1
    return cut(some.withColumn("at", at).where("at < wanted").select("cell", "at", "vec"))


def _against(frame: DataFrame, inner: DataFrame, meet, schema: str) -> DataFrame:
    """``meet`` (rows, pivots by number) of rows of large cells, SLICE_ROWS or so at a time, with the pivots of their cell."""
    slices = frame.groupBy("cell").agg(F.ceil(F.count("*") / SLICE_ROWS).alias("slices"))  # a row for each cell
    dealt = frame.join(F.broadcast(slices), "cell").withColumn("slice", F.pmod(F.xxhash64(F.lit(6), "row_idx"), F.col("slices"))).drop("slices")
    spread = inner.join(F.broadcast(slices), "cell").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices")
    spread = spread.select(*(F.col(c).alias(c) for c in spread.columns))  # pivots are drawn from rows: columns of their own
    target = to_arrow_schema(StructType.fromDDL(schema))
    names = target.names

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return meet(left, right.sort_by("at")).select(names) if len(left) and len(right) else target.empty_table()

    return dealt.groupBy("cell", "slice").cogroup(spread.groupBy("cell", "slice")).applyInArrow(run, schema)


def _in_leaves(frame: DataFrame, inner: DataFrame | None, split: list[int], extra: list[str]) -> DataFrame:
    """Rows of cells with their ``leaf``: number of the cell times CELLS, and in a cell that is split the nearest pivot's
    number besides; ``inside`` is how far away that is."""
    whole = frame.where(~F.col("cell").isin(split)).select("row_idx", "vec", *extra, "cell", (F.col("cell") * CELLS).alias("leaf"), F.lit(0.0).alias("inside"))
    if not split:
        return whole

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        d = _apart(_matrix(left["vec"]), _matrix(right["vec"]))
        at = d.argmin(axis=1)
        leaf = left["cell"].to_numpy().astype(np.int64) * CELLS + right["at"].to_numpy()[at]
        return left.append_column("leaf", pa.array(leaf.astype(np.int32))).append_column("inside", pa.array(d[np.arange(len(d)), at]))

    fields = {f.name: f.dataType.simpleString() for f in frame.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in ("row_idx", "vec", *extra, "cell")) + ", leaf int, inside double"
    return whole.unionByName(_against(frame.where(F.col("cell").isin(split)), inner, meet, schema))


def _inner_visits(abroad: DataFrame, rows: DataFrame, inner: DataFrame, split: list[int], extra: list[str]) -> DataFrame:
    """Visits to cells that are split become visits to their shelves with a leaf within the bound, a query's own left out."""
    radii = rows.where(F.col("cell").isin(split)).groupBy("leaf").agg(F.max("inside").alias("radius"))
    held = inner.withColumn("leaf", F.col("cell") * CELLS + F.col("at")).join(radii, "leaf")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        x, p = _matrix(left["vec"]), _matrix(right["vec"])
        leaf = right["leaf"].to_numpy()
        near = _within(x, p, right["radius"].to_numpy(), pc.fill_null(left["bound"], np.inf).to_numpy()) & (leaf != left["leaf"].to_numpy()[:, None])
        i, shelf = _once_a_shelf(near, leaf - leaf % SHELF_LEAVES)
        return left.take(pa.array(i)).drop_columns("shelf").append_column("shelf", pa.array(shelf.astype(np.int32)))

    fields = {f.name: f.dataType.simpleString() for f in abroad.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in ("row_idx", "vec", *extra, "bound", "leaf", "shelf"))
    deeper = _against(abroad.where("shelf is null"), held, meet, schema)
    return abroad.where("shelf is not null").select("row_idx", "vec", *extra, "bound", "leaf", "shelf").unionByName(deeper)


def _within(x: np.ndarray, pivots: np.ndarray, radius: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Which pivots' rows may lie within each row's bound."""
    # rounding may move a distance from a pivot by this share of the largest norm
    slack = 1e-7 * (1 + np.sqrt((pivots**2).sum(1)).max())
    return ~(_apart(x, pivots) - radius - slack * (1 + np.sqrt((x**2).sum(1)))[:, None] > bound[:, None])


def _once_a_shelf(near: np.ndarray, shelf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shelf) of each row and each shelf with a leaf that is near."""
    names, starts = np.unique(shelf, return_index=True)
    order = np.argsort(shelf, kind="stable")
    starts = np.searchsorted(shelf[order], names)
    if not len(names):
        return np.zeros(0, np.int64), names
    i, j = np.nonzero(np.logical_or.reduceat(near[:, order], starts, axis=1))
    return i, names[j]


def _visits(asked: DataFrame, pivots: np.ndarray, radii: dict[int, float], split: list[int], shelves: dict[int, int], extra: list[str]) -> DataFrame:
    """Queries once for each shelf of whole cells that may hold a row within their bound (null: any row) outside their own
    leaf, and once for each cell that is split (shelf null); ``leaf`` is the one they come from."""
    whole, again = np.array(sorted(shelves), np.int64), np.array(split, np.int64)
    shelf = np.array([shelves[c] for c in whole.tolist()], np.int64)
    reach = lambda cells: np.array([radii[c] for c in cells.tolist()])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                b = batch.slice(lo, SLICE_ROWS)
                bound = pc.fill_null(b["bound"], np.inf).to_numpy(zero_copy_only=False)
                x, kept = _matrix(b["vec"]), b.select(["row_idx", "vec", *extra, "bound", "leaf"])
                names = ["row_idx", "vec", *extra, "bound", "leaf", "cell", "shelf"]
                if len(whole):
                    near = _within(x, pivots[whole], reach(whole), bound) & (whole != b["cell"].to_numpy()[:, None])
                    i, there = _once_a_shelf(near, shelf)
                    for at in range(0, len(i), SLICE_ROWS * 16):
                        part = slice(at, at + SLICE_ROWS * 16)
                        held, none = kept.take(pa.array(i[part])), pa.nulls(len(i[part]), pa.int32())
                        yield pa.RecordBatch.from_arrays([*held.columns, none, pa.array(there[part].astype(np.int32))], names=names)
                if len(again):
                    i, j = np.nonzero(_within(x, pivots[again], reach(again), bound))
                    for at in range(0, len(i), SLICE_ROWS * 16):
                        part = slice(at, at + SLICE_ROWS * 16)
                        held, none = kept.take(pa.array(i[part])), pa.nulls(len(i[part]), pa.int32())
                        yield pa.RecordBatch.from_arrays([*held.columns, pa.array(again[j[part]].astype(np.int32)), none], names=names)

    fields = {f.name: f.dataType.simpleString() for f in asked.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in ("row_idx", "vec", *extra)) + ", bound double, leaf int, cell int, shelf int"
    return asked.select("row_idx", "vec", *extra, "cell", "bound", "leaf").mapInArrow(run, schema)


def _compared(asked: DataFrame, rows: DataFrame, k: int, target: str | None, block_rows: int, apart: bool, home: bool) -> DataFrame:
    """(query, row_idx, distance): k rows of each query's shelf at least where there are, block by block. At home a query is
    held against its own leaf, else against the other leaves of the shelf that reach within its ``bound``."""
    extra = [target] if target else []
    of = lambda f, name: f.groupBy("shelf").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    parts = of(rows, "rows").join(of(asked, "asked"), "shelf")
    deal = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "row_idx"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(parts, "shelf").select("row_idx", "vec", *extra, "shelf", "leaf", "bound", F.lit(True).alias("__q"), deal(1, "asked").alias("__i"), each("rows").alias("__j"))
    right = rows.join(parts, "shelf").select("row_idx", "vec", *extra, "shelf", "leaf", F.lit(None).cast("double").alias("bound"), F.lit(False).alias("__q"), each("asked").alias("__i"), deal(2, "rows").alias("__j"))

    def compare(t: pa.Table) -> pa.Table:
        q = t["__q"].to_numpy()
        out = [pa.table({"query": pa.array([], pa.int64()), "row_idx": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})]
        if q.all() or not q.any():
            return out[0]
        ids, leaf, x = t["row_idx"].to_numpy().astype(np.int64), t["leaf"].to_numpy(), _matrix(t["vec"])
        bound = pc.fill_null(t["bound"], np.inf).to_numpy(zero_copy_only=False)[q]
        kinds = pc.dictionary_encode(t[target].combine_chunks(), null_encoding="encode").indices.to_numpy() if target else np.zeros(len(t), np.int8)
        a, ia, la, ka = x[q], ids[q], leaf[q], kinds[q]
        order = np.argsort(leaf[~q], kind="stable")
        b, ib, lb, kb = (v[~q][order] for v in (x, ids, leaf, kinds))
        del x
        a2, b2 = (a**2).sum(1), (b**2).sum(1)
        # rounding moves a squared distance, either way it is computed, by no more than ``off``
        off = 4 * (a.shape[1] + 8) * np.finfo(np.float64).eps * (a2 + b2.max())
        starts = np.append(np.flatnonzero(np.append(True, lb[1:] != lb[:-1])), len(lb))
        tiles = [(lo, min(lo + BLOCK_ROWS, end)) for first, end in zip(starts[:-1], starts[1:], strict=True) for lo in range(first, end, BLOCK_ROWS)]
        if home:
            near = la[:, None] == lb[[lo for lo, _ in tiles]]
        else:
            centres = np.stack([b[lo:hi].mean(0) for lo, hi in tiles])
            radius = np.array([np.sqrt(((b[lo:hi] - c) ** 2).sum(1).max()) for (lo, hi), c in zip(tiles, centres, strict=True)])
            near = _within(a, centres, radius, bound) & (la[:, None] != lb[[lo for lo, _ in tiles]])
        for top in range(0, len(a), TILE_ROWS):
            best = []
            for tile, (lo, hi) in enumerate(tiles):
                s = top + np.flatnonzero(near[top : top + TILE_ROWS, tile])
                if not len(s):
                    continue
                d = a2[s, None] + b2[lo:hi] - 2 * (a[s] @ b[lo:hi].T)
                hide = ia[s, None] == ib[lo:hi] if apart else np.zeros(d.shape, bool)
                if target:
                    hide |= ka[s, None] == kb[lo:hi]
                d[hide] = np.inf
                far = bound[s] ** 2
                within = ~(d > (far + 2 * off[s])[:, None]) & ~hide
                if k < d.shape[1] and within.sum(1).max() > 2 * k:
                    far = np.minimum(far, np.partition(d, k - 1, axis=1)[:, k - 1])
                    within &= ~(d > (far + 2 * off[s])[:, None])
                i, j = np.nonzero(within)
                best.append((s[i], lo + j))
            if not best:
                continue
            i, j = (np.concatenate(v) for v in zip(*best, strict=True))
            step = max(1, int(1e6) // max(1, a.shape[1]))
            exact = np.concatenate([np.sqrt(((a[i[lo : lo + step]] - b[j[lo : lo + step]]) ** 2).sum(-1)) for lo in range(0, len(i), step)] or [np.zeros(0)])
            ok = np.isfinite(exact)
            i, j, exact = i[ok], j[ok], exact[ok]
            order = np.lexsort((ib[j], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append(pa.table({"query": ia[i[first]], "row_idx": ib[j[first]], "distance": exact[first]}))
        return pa.concat_tables(out)

    # both sides come dealt by their shelf, each in partitions joined by its own sizes: what meets is dealt anew
    met = left.unionByName(right).repartition("shelf", "__i", "__j")
    return met.groupBy("shelf", "__i", "__j").applyInArrow(compare, "query long, row_idx long, distance double")


def default_clusters(n: int) -> int:
    """round(sqrt(n) / 4) between 4 and 24."""
    return max(4, min(24, math.floor(math.sqrt(n) / 4 + 0.5)))


def assign(points: DataFrame, centres: list[tuple[float, float]]) -> DataFrame:
    """Points with the nearest centre as ``cluster``, the lowest on ties: an expression, no shuffle."""
    away = [F.struct(((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy)).alias("d"), F.lit(i).alias("i")) for i, (cx, cy) in enumerate(centres)]
    return points.withColumn("cluster", F.array_min(F.array(*away))["i"])


def kmeans_2d(points: DataFrame, k: int, seed: int = 42, rounds: int = 60) -> tuple[DataFrame, list[tuple[float, float]]]:
    """Points (row_idx, x, y) with ``cluster``, and the centres.

    Centres start at ``seed_centres`` and move to the means of their points until no point changes its cluster, which the
    number of a cluster's points and the exclusive or of their hashes tell without a second assignment. A round is one
    job, and only k rows reach the driver.
    """
    points = points.select("row_idx", "x", "y").where("x is not null and y is not null").persist()
    try:
        centres = seed_centres(points, k, seed)
        before = None
        for _ in range(rounds if centres else 0):
            rows = assign(points, centres).groupBy("cluster").agg(F.avg("x"), F.avg("y"), F.count("*"), F.bit_xor(F.xxhash64("row_idx"))).collect()
            held = {r[0]: (r[3], r[4]) for r in rows}
            if held == before:
                break
            before, means = held, {r[0]: (r[1], r[2]) for r in rows}
            centres = [means.get(i, c) for i, c in enumerate(centres)]
        return assign(points, centres), centres
    finally:
        points.unpersist()


def seed_centres(points: DataFrame, k: int, seed: int = 42) -> list[tuple[float, float]]:
    """At most k different positions of points (row_idx, x, y), far from each other; fewer only where there are fewer.

    Oversampling: in each of ``SEED_ROUNDS`` rounds a point is drawn with odds of 2k times its share of all squared
    distances to the nearest drawn one, so about 2k at a time (rounds go on while there are less than k). Then k of the
    drawn, weighted by the points nearest to them, are chosen one by one with odds by weight and squared distance. Draws
    are keyed hashes of row_idx, so they do not depend on partitions; the number of jobs does not depend on k.
    """
    unit = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "row_idx"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    first = points.agg(F.min_by(F.struct("x", "y"), F.struct(unit(0).alias("u"), "row_idx"))).first()[0]
    drawn = [] if first is None else [tuple(first)]
    step = 0
    while drawn and (step < SEED_ROUNDS or len(drawn) < k):
        step += 1
        away = _nearest(drawn)["d"]
        all_ = points.agg(F.sum(away)).first()[0]
        if not all_ > 0:
            break
        drawn += sorted(map(tuple, points.where(unit(step) < 2 * k * away / all_).select("x", "y").distinct().collect()))
    if len(drawn) <= k:
        return drawn
    near = dict(map(tuple, points.groupBy(_nearest(drawn)["i"].alias("i")).agg(F.count("*")).collect()))
    at, weight = np.array(drawn), np.array([near.get(i, 0) for i in range(len(drawn))], dtype=float)
    rng = np.random.default_rng(seed)
    chosen: list[int] = []
    odds = weight
    while len(chosen) < k and odds.sum() > 0:
        chosen.append(int(rng.choice(len(at), p=odds / odds.sum())))
        odds = weight * np.min([((at - at[i]) ** 2).sum(1) for i in chosen], axis=0)
    return [drawn[i] for i in chosen]


def _nearest(centres: list[tuple[float, float]]) -> Column:
    """(d, i): the least squared distance to a centre and its number, the lowest on ties; one expression for any number."""
    rows = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(i).alias("i")) for i, (x, y) in enumerate(centres)))
    away = lambda c: (F.col("x") - c["x"]) * (F.col("x") - c["x"]) + (F.col("y") - c["y"]) * (F.col("y") - c["y"])
    return F.array_min(F.transform(rows, lambda c: F.struct(away(c).alias("d"), c["i"].alias("i"))))


def smooth_bandwidths(distances: np.ndarray, k: int, connectivity: float) -> tuple[np.ndarray, np.ndarray]:
    """sigma and rho of each row of sorted distances: with sigma, memberships beyond the first sum to log2(k)."""
    n, m = distances.shape
    rho = np.zeros(n)
    whole, part = int(connectivity), connectivity - int(connectivity)
    if connectivity > 0 and m:  # distances ascend, so the positive ones are the last
        zeros = (distances <= 0).sum(axis=1)
        at = lambda j: distances[np.arange(n), np.minimum(zeros + j, m - 1)]
        enough = m - zeros >= connectivity
        exact = at(whole - 1) + (part * (at(whole) - at(whole - 1)) if part > 1e-5 else 0) if whole > 0 else part * at(0)
        rho = np.where(enough, exact, np.where(zeros < m, distances[:, -1], 0.0))
    low, high, mid = np.zeros(n), np.full(n, np.inf), np.ones(n)
    over = np.maximum(distances[:, 1:] - rho[:, None], 0)
    open_ = np.ones(n, bool)
    for _ in range(64):
        total = np.exp(-over / mid[:, None]).sum(1)
        open_ &= np.abs(total - math.log2(k)) >= 1e-5
        wide = open_ & (total > math.log2(k))
        thin = open_ & ~wide
        high[wide] = mid[wide]
        low[thin] = mid[thin]
        mid[wide] = (low[wide] + high[wide]) / 2
        grow = thin & np.isinf(high)
        mid[grow] *= 2
        rest = thin & ~grow
        mid[rest] = (low[rest] + high[rest]) / 2
    return np.maximum(mid, 1e-3 * distances.mean(axis=1) if m else mid), rho


def memberships_of(found: DataFrame, k: int, connectivity: float) -> DataFrame:
    """``nearest`` results with ``weight``: strength of each neighbour, and ``share``: strengths that sum to 1 per query."""
    gathered = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "row_idx", "distance"))).alias("h"))  # k entries each
    plain = gathered.select("query", F.col("h.row_idx").alias("row_idx"), F.col("h.distance").alias("distance"))

    def run(batches):
        for pdf in batches:
            sizes = pdf.distance.map(len)
            for size, g in pdf.groupby(sizes):
                d = np.stack(g.distance.to_list())
                sigma, rho = smooth_bandwidths(d, min(k, size), connectivity)
                w = np.where(d <= rho[:, None], 1.0, np.exp(-np.maximum(d - rho[:, None], 0) / np.maximum(sigma, 1e-300)[:, None]))
                total = w.sum(1, keepdims=True)
                share = np.where(total > 0, w / np.where(total > 0, total, 1), 1 / size)
                yield pd.DataFrame({"query": np.repeat(g["query"].to_numpy(), size), "row_idx": np.concatenate(g.row_idx.to_list()), "distance": d.ravel(), "rank": np.tile(np.arange(1, size + 1), len(g)), "weight": w.ravel(), "share": share.ravel()})

    return plain.mapInPandas(run, "query long, row_idx long, distance double, rank int, weight double, share double")


def place(queries: DataFrame, vectors: DataFrame, coords: DataFrame, k: int = NEIGHBOURS) -> tuple[DataFrame, DataFrame]:
    """(query, x, y) of outside vectors on a fixed map, the weighted mean of their neighbours; and the neighbours."""
    near = memberships_of(nearest(vectors, queries, k), k, 0.0)
    at = near.join(coords.select("row_idx", "x", "y"), "row_idx").groupBy("query").agg(F.sum(F.col("share") * F.col("x")).alias("x"), F.sum(F.col("share") * F.col("y")).alias("y"))
    return at, near


def transfer(near: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """(query, label): the heaviest vote of the neighbours, the nearest holder's on ties."""
    votes = near.join(labels.select("row_idx", column).where(F.col(column).isNotNull()), "row_idx").groupBy("query", column).agg(F.round(F.sum("share"), 12).alias("w"), F.min("rank").alias("first"))
    return votes.groupBy("query").agg(F.max_by(column, F.struct("w", (-F.col("first")).alias("f"))).alias(column))


def attach(map_points: DataFrame, placed: DataFrame) -> DataFrame:
    """The map with new points behind it; a pid that is there already is not taken twice, and no other row changes."""
    return map_points.unionByName(placed.join(map_points.select("pid"), "pid", "left_anti"), allowMissingColumns=True)


def reproject(map_points: DataFrame, placed: DataFrame) -> DataFrame:
    """The map with new coordinates and clusters for the pids in ``placed``; unknown pids add nothing."""
    new = placed.select("pid", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("cluster").alias("nc"))
    return map_points.join(new, "pid", "left").withColumn("x", F.coalesce("nx", "x")).withColumn("y", F.coalesce("ny", "y")).withColumn("cluster", F.coalesce("nc", "cluster")).drop("nx", "ny", "nc")


def fuzzy_graph(vectors: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(a, b, weight), a < b: neighbour strengths of both directions joined as x + y - xy."""
    near = memberships_of(nearest(vectors, k=k), k, 1.0).where("weight > 0")
    pair = near.select(F.least("query", "row_idx").alias("a"), F.greatest("query", "row_idx").alias("b"), "weight")
    return pair.groupBy("a", "b").agg((F.sum("weight") - F.when(F.count("*") > 1, F.exp(F.sum(F.log("weight")))).otherwise(0.0)).alias("weight"))


def layout_2d(graph: DataFrame, tolerance: float = 1e-3, steps: int = 80, seed: int = 42, coarse: int = COARSE_NODES) -> DataFrame:
    """(node, x, y): the two leading non-trivial eigenvectors of the normalized graph, over its degrees' roots.

    The graph is contracted to ``coarse`` nodes at most, whose axes are exact and start those of the whole graph. Then
    conjugate steps: the best AXES axes within the last ones, their residuals and their last moves, until the first two
    leave a residual of ``tolerance`` at most; if they do not within ``steps``, that is an error. The further axes are not
    returned: where many parts hang together loosely, values close behind the second would hold two axes up for long. A
    step is one join with the edges and one sum; a node keeps 6 * AXES numbers, and the driver small matrices. A graph in
    several parts has axes that are constant on each part. An axis points where its first node (by number) that is not
    near zero is positive.
    """
    graph = cut(graph.select("a", "b", "weight"))  # both directions are read from one graph
    both = cut(graph.select(F.col("a").alias("u"), F.col("b").alias("v"), "weight").unionByName(graph.select(F.col("b").alias("u"), F.col("a").alias("v"), "weight")).groupBy("u", "v").agg(F.sum("weight").alias("weight")))
    degree = cut(both.groupBy("u").agg(F.sum("weight").alias("deg")))
    nodes, total = degree.agg(F.count("*"), F.sum("deg")).first()
    if nodes < 3:
        return degree.select(F.col("u").alias("node"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    edges = cut(both.join(degree, "u").join(degree.select(F.col("u").alias("v"), F.col("deg").alias("dv")), "v").select("u", "v", (F.col("weight") / F.sqrt(F.col("deg") * F.col("dv"))).alias("w")))
    root = F.sqrt("deg")
    begun = degree.join(_coarse_axes(both, nodes, coarse, seed), "u")
    state = begun.select("u", (root / math.sqrt(total)).alias("t"), F.transform("y", lambda y: root * y).alias("s"), F.array().cast("array<double>").alias("a"))
    state = _multiplied(state, edges, AXES)
    for step in range(steps + 1):
        along, own, mixed, twice = _products(state)
        values, c = _best_axes(own, mixed, AXES)
        left = np.array([math.sqrt(max(0.0, w @ (twice - 2 * v * mixed + v**2 * own) @ w)) for v, w in zip(values, c.T, strict=True)])
        if max(left[:2]) <= tolerance:
            break
        if step == steps:
            raise ArithmeticError(f"the layout's axes did not settle within {steps} steps: {max(left[:2]):.3g} is left of {tolerance:.3g}")
        moves = c.copy()
        moves[:AXES] = 0
        long = np.sqrt(np.maximum(np.einsum("ki,kl,li->i", moves, own, moves), 0))
        moves = moves[:, long > 1e-12] / long[long > 1e-12]
        kept, zero = np.hstack([c, moves]), np.zeros_like
        kept, moved = kept[:, :AXES], kept[:, AXES:]
        open_ = left > 1e-12
        d, v = c[:, open_] / left[open_], values[open_]
        # rows: t, s, a; the trivial axis stays out of what is found
        axis = np.vstack([-(along @ kept), kept, zero(kept)]), np.vstack([-(along @ kept), zero(kept), kept])
        past = np.vstack([-(along @ moved), moved, zero(moved)]), np.vstack([-(along @ moved), zero(moved), moved])
        rest = np.vstack([-(1 - v) * (along @ d), -d * v, d])
        state = _combined(state, np.hstack([axis[0], past[0], rest]), np.hstack([axis[1], past[1]]))
        state = _multiplied(state, edges, rest.shape[1])
    ends = np.vstack([-(along @ c[:, :2]), c[:, :2], np.zeros_like(c[:, :2])])
    found = _combined(state, ends, ends[:, :0]).select(F.col("u").alias("node"), F.get("s", 0).alias("x"), F.get("s", 1).alias("y"), "t")
    sign = lambda c: F.coalesce(F.min_by(F.signum(c), F.when(F.abs(F.col(c)) > 1e-6, F.col("node"))), F.lit(1.0)).alias(f"s{c}")
    found = found.crossJoin(F.broadcast(found.agg(sign("x"), sign("y"))))
    norm = math.sqrt(total)
    return found.select("node", (F.col("x") * F.col("sx") / (F.col("t") * norm)).alias("x"), (F.col("y") * F.col("sy") / (F.col("t") * norm)).alias("y"))


def _combined(state: DataFrame, to_s: np.ndarray, to_a: np.ndarray) -> DataFrame:
    """The state (u, t, s, a) with sums of (t, s, a) as new s and a, by the weights in the columns."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                z = np.hstack([b["t"].to_numpy()[:, None], _matrix(b["s"]), _matrix(b["a"])])
                made = (pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * m.shape[1]), pa.array((z @ m).ravel())) for m in (to_s, to_a))
                yield pa.RecordBatch.from_arrays([b["u"], b["t"], *made], names=["u", "t", "s", "a"])

    fields = {f.name: f.dataType.simpleString() for f in state.schema}
    return state.mapInArrow(run, f"u {fields['u']}, t double, s array<double>, a array<double>")


def _multiplied(state: DataFrame, edges: DataFrame, last: int) -> DataFrame:
    """The state with the graph's products of the last numbers of s behind a."""
    ends = state.select(F.col("u").alias("v"), F.slice("s", -last, last).alias("x"))
    sums = F.array(*(F.sum(F.col("w") * F.col("x")[i]) for i in range(last))).alias("more")
    return cut(state.join(edges.join(ends, "v").groupBy("u").agg(sums), "u").select("u", "t", "s", F.concat("a", "more").alias("a")))


def _products(state: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """t's, s x s, s x a and a x a of the basis, in one pass; the last three without their parts along the trivial axis,
    which the graph maps on itself."""
    g = gram(state.select(F.concat(F.array("t"), "s", "a").alias("vec")))
    w = len(g) // 2
    along, trivial = g[0, 1 : w + 1], np.outer(g[0, 1 : w + 1], g[0, 1 : w + 1])
    mixed = g[1 : w + 1, w + 1 :]
    return along, g[1 : w + 1, 1 : w + 1] - trivial, (mixed + mixed.T) / 2 - trivial, g[w + 1 :, w + 1 :] - trivial


def _best_axes(own: np.ndarray, mixed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest Ritz values of a basis, ``most`` with zeros where there are fewer, and its weights of their unit axes;
    directions that repeat others drop out."""
    there = np.diag(own) > 1e-24 * max(1e-276, np.diag(own).max())
    scale = np.where(there, 1 / np.sqrt(np.where(there, np.diag(own), 1)), 0)
    size, turn = np.linalg.eigh(own * np.outer(scale, scale))
    good = size > 1e-10
    basis = scale[:, None] * turn[:, good] / np.sqrt(size[good])
    ritz, axes = np.linalg.eigh(basis.T @ mixed @ basis)
    axes = basis @ axes[:, ::-1][:, :most]
    values = ritz[::-1][:most]
    missing = most - len(values)
    return np.pad(values, (0, missing)), np.pad(axes, ((0, 0), (0, missing)))


def _coarse_axes(both: DataFrame, nodes: int, coarse: int, seed: int) -> DataFrame:
    """(u, y): the AXES leading axes, over degrees' roots, of the graph contracted to ``coarse`` nodes, for all its nodes.

    A keyed coin makes nodes heads or tails in every round; tails go into the heaviest head beside them, and weights add
    up. Rounds shrink the graph by a share, so all together cost a few times the first. Where no edge is left between the
    nodes, and they are more, any numbers a node are axes; so are those that a small graph has not.
    """
    maps: list[DataFrame] = []
    edges, left, idle = both, nodes, 0
    while left > coarse and idle < 8:
        head = lambda c, n=len(maps) + idle: F.pmod(F.xxhash64(F.lit(seed), F.lit(n), c), F.lit(2)) == 0
        goes = edges.where(~head(F.col("u")) & head(F.col("v"))).groupBy("u").agg(F.max_by("v", F.struct("weight", F.xxhash64("u", "v").alias("h"), "v")).alias("to"))
        into = cut(edges.select("u").distinct().join(goes, "u", "left").select("u", F.coalesce("to", "u").alias("to")))
        now = into.select("to").distinct().count()
        if now == left:
            if edges.where("u <> v").isEmpty():
                break
            idle += 1
            continue
        left, idle = now, 0
        maps.append(into)
        edges = cut(edges.join(into, "u").select(F.col("to").alias("u"), "v", "weight").join(into.select(F.col("u").alias("v"), F.col("to").alias("tv")), "v").groupBy("u", F.col("tv").alias("v")).agg(F.sum("weight").alias("weight")))
    number = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(f"axis {i}"), "u"), F.lit(2_000_001)) / 1e6 - 1
    given = 2 if left < 3 else AXES
    known = edges.select("u").distinct().select("u", F.array(*map(number, range(given))).alias("y"))
    if 3 <= left <= coarse:
        rows = edges.toPandas()  # coarse * coarse rows at most
        ids, ends = np.unique(rows.u.to_numpy(), return_inverse=True)
        w = np.zeros((len(ids), len(ids)))
        w[ends, np.searchsorted(ids, rows.v.to_numpy())] = rows.weight
        deg = np.sqrt(w.sum(1))
        trivial = deg / np.linalg.norm(deg)
        axes = np.linalg.eigh(w / np.outer(deg, deg) - 2 * np.outer(trivial, trivial))[1][:, ::-1][:, : min(AXES, left - 1)] / deg[:, None]
        given = axes.shape[1]
        known = F.broadcast(both.sparkSession.createDataFrame(pd.DataFrame({"u": ids, "y": axes.tolist()}), f"u {dict(edges.dtypes)['u']}, y array<double>"))
    for into in reversed(maps):
        known = into.join(known.withColumnRenamed("u", "to"), "to").select("u", "y")
    # what a small graph has not is drawn node by node, as constants on its few parts would say nothing new
    return known.select("u", F.concat("y", F.array(*map(number, range(given, AXES))).cast("array<double>")).alias("y"))
