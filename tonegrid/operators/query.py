"""Questions to a map: search, lasso, viewport, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.functions.music import decade, genre_key
from tonegrid.operators.analytics import TempoScale

#: Letters of the runs that tracks and queries meet on.
GRAM = 3


def search(tracks: DataFrame, queries: DataFrame, limit: int | None = 20, title: str = "title", artist: str = "by") -> DataFrame:
    """(query_id, rank, pid, score) of tracks whose folded title and artist hold every token of a folded query.

    4 the title starts with the query, 3 the artist does, 2 the title holds it, 1 the artist does, else 0; row order on
    ties. Tracks and queries (query_id, q) meet on a run of up to ``GRAM`` letters of the query's longest token, an
    equality that the planner broadcasts for few queries and shuffles for many; all tokens are then checked. Tracks are
    known by runs of the lengths that queries ask for, and no others.
    """
    t, a, q = F.col(title), F.coalesce(F.col(artist), F.lit("")), F.col("q")
    both = F.concat(t, F.lit(" "), a)
    longest = F.element_at(F.array_sort(F.transform(F.split(q, " "), lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), -1)["x"]
    asked = queries.where("q <> ''").withColumn("gram", F.substring(longest, 1, GRAM)).where("gram <> ''")
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.length(both) - n + 1), lambda i: F.substring(both, i, F.lit(n)))
    lengths = [r[0] for r in asked.select(F.length("gram")).distinct().collect()]  # GRAM at most
    some = [F.when(F.length(both) >= n, grams(n)).otherwise(F.array().cast("array<string>")) for n in sorted(lengths) or [GRAM]]
    held = tracks.withColumn("gram", F.explode(F.array_distinct(F.concat(*some))))
    met = held.join(asked, "gram").where(F.forall(F.split(q, " "), lambda token: both.contains(token)))
    score = F.when(t.startswith(q), 4).when(a.startswith(q), 3).when(t.contains(q), 2).when(a.contains(q), 1).otherwise(0)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_idx")
    ranked = met.withColumn("score", score).withColumn("rank", F.row_number().over(best))
    return (ranked if limit is None else ranked.where(F.col("rank") <= limit)).select("query_id", "rank", "pid", "score")


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd rule with half-open edges; fewer than three corners hold nothing. The bounding box is tested first."""
    if len(polygon) < 3:
        return F.lit(False)
    xs, ys = zip(*polygon, strict=True)
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if y1 != y2:
            crossings = crossings + F.when(((F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (crossings % 2 == 1)


def in_polygons(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(polygon_id, row_idx) of points (row_idx, x, y) inside polygons (polygon_id, corners: array of (x, y)), by the rule of
    ``in_polygon``.

    They meet in grid cells: a polygon's cells have a side of the power of two that is at least a quarter of its box, so
    it lies in 25 of them at most, and a point in one for each side in use. The edges of the polygons of a cell decide. Null
    corners are left out; a polygon without extent, or with fewer than three corners, holds nothing.
    """
    x, y, cs = F.col("x"), F.col("y"), F.col("corners")
    end = lambda pick, c: pick(F.transform("corners", lambda p: p[c]))
    boxes = polygons.withColumn("corners", F.filter("corners", lambda p: p["x"].isNotNull() & p["y"].isNotNull())).where(F.size("corners") >= 3)
    boxes = boxes.select("polygon_id", "corners", *(end(pick, c).alias(f"{c}{i}") for c in "xy" for i, pick in enumerate((F.array_min, F.array_max))))
    boxes = boxes.withColumn("side", F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).where("side > 0")
    boxes = boxes.withColumn("level", F.ceil(F.log2("side")).cast("int") - 2)
    levels = boxes.select("level").distinct()  # as many as powers of two between the smallest and the largest box
    cell = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("level")))
    over = lambda c: F.sequence(cell(F.col(f"{c}0")), cell(F.col(f"{c}1")))
    held = boxes.withColumn("cx", F.explode(over("x"))).withColumn("cy", F.explode(over("y")))
    asked = points.select("row_idx", "x", "y").where("x is not null and y is not null").crossJoin(F.broadcast(levels)).withColumns({"cx": cell(x), "cy": cell(y)})
    met = asked.join(held, ["level", "cx", "cy"]).where(x.between(F.col("x0"), F.col("x1")) & y.between(F.col("y0"), F.col("y1")))
    n = F.size(cs)

    def crossed(i):
        a, b = F.get(cs, i), F.get(cs, F.when(i + 1 < n, i + 1).otherwise(0))
        return ((a["y"] > y) != (b["y"] > y)) & (x < F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"])

    return met.where(F.size(F.filter(F.sequence(F.lit(0), n - 1), crossed)) % 2 == 1).select("polygon_id", "row_idx")


def in_viewport(x: Column, y: Column, box: tuple[float, float, float, float], margin: float = 0.05) -> Column:
    """Inside (x0, y0, x1, y1) with a margin of its sides."""
    x0, y0, x1, y1 = box
    dx, dy = (x1 - x0) * margin, (y1 - y0) * margin
    return x.between(x0 - dx, x1 + dx) & y.between(y0 - dy, y1 + dy)


def highlighted(tracks: DataFrame, kind: str, value, memberships: DataFrame | None = None, scale: TempoScale | None = None) -> DataFrame:
    """Tracks of one playlist, cluster, collection, genre, key, decade or bin of a tempo scale."""
    if kind == "playlist":
        return tracks.join(memberships.where(F.col("playlist") == value).select("pid").distinct(), "pid", "left_semi")
    column = {
        "cluster": lambda: F.col("cluster"), "collection": lambda: F.col("collection"), "genre": lambda: genre_key(F.col("genre")), "key": lambda: F.col("key"),
        "decade": lambda: decade(F.col("year")), "bpm": lambda: scale.bin(F.col("bpm")),
    }[kind]()
    return tracks.where(column == value)


def first_layer(layers: list[tuple[str, DataFrame]]) -> DataFrame:
    """(layer, pid, active) of all layers: those of the first one that is not empty are active, the rest wait."""
    out = None
    for i, (name, frame) in enumerate(layers):
        rows = frame.select(F.lit(i).alias("priority"), F.lit(name).alias("layer"), "pid")
        out = rows if out is None else out.unionByName(rows)
    least = out.agg(F.min("priority").alias("least"))
    return out.crossJoin(F.broadcast(least)).select("layer", "pid", (F.col("priority") == F.col("least")).alias("active"))
