"""Tracks from outside on a fitted map, and edited tracks moved on it: compositions of encoding, projection and placing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrid.functions.music import tempo_key_vector
from tonegrid.operators.features import Encoder, encode, vectors
from tonegrid.operators.geometry import NEIGHBOURS, attach, place, project, reproject, transfer


def place_outside(outside: DataFrame, encoder: Encoder, basis: np.ndarray | None, fitted: DataFrame, map_points: DataFrame, library: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(pid, row_idx, x, y, cluster, genre, projected) of outside tracks on a map that does not change.

    outside has row_idx values of its own. A track's genre comes from its neighbours, and is marked so, only where it
    states none. Nothing is fitted again.
    """
    vec = vectors(encode(outside, encoder), encoder, outside)
    at, near = place(vec if basis is None else project(vec, basis), fitted, map_points, k)
    cluster, genre = transfer(near, map_points, "cluster"), transfer(near, library, "genre").withColumnRenamed("genre", "voted")
    rows = outside.select("pid", F.col("row_idx").alias("query"), "genre").join(at, "query").join(cluster, "query", "left").join(genre, "query", "left")
    return rows.select("pid", F.col("query").alias("row_idx"), "x", "y", "cluster", F.coalesce("genre", "voted").alias("genre"), (F.col("genre").isNull() & F.col("voted").isNotNull()).alias("projected"))


def attach_outside(map_points: DataFrame, placed: DataFrame) -> DataFrame:
    """The map with the placed tracks behind it; known pids are refused."""
    return attach(map_points, placed.select("pid", "row_idx", "x", "y", "cluster"))


def move_edited(tracks: DataFrame, map_points: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The map with every manually edited track (source_bpm or source_key is manual) at its place by tempo and key.

    All move against the fitted map at once, so no move sees another; a track is not its own neighbour.
    """
    known = tracks.where("bpm is not null or key is not null").withColumn("vec", tempo_key_vector(F.col("bpm"), F.col("key")))
    edited = known.where("source_bpm = 'manual' or source_key = 'manual'").select("row_idx", "vec")
    at, near = place(edited, known.select("row_idx", "vec"), map_points, k)
    moved = at.join(transfer(near, map_points, "cluster"), "query").join(tracks.select(F.col("row_idx").alias("query"), "pid"), "query")
    return reproject(map_points, moved)
