"""The driver's tables seen as tracks, playlists, sets, map points and lookups, with deliberate gaps.

The expressions are plain SQL, so that the DuckDB statements of the oracles read the same views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: view: (table, expressions, distinct)
VIEWS = {
    "tracks": ("part", [
        "p_partkey AS row_idx",
        "'rb:' || CAST(p_partkey AS STRING) AS pid",
        "p_name AS name",
        "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS artist",
        "p_type AS genre",
        "1947 + p_size AS year",
        "120000 + (p_partkey * 7919) % 300000 AS duration_ms",
        "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(90 + (p_partkey * 37) % 90 AS DOUBLE) END AS bpm",
        "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(1 + (p_partkey * 7) % 12 AS STRING) || CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END END AS key",
        "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' Records' ELSE '' END END AS label",
        "'c' || CAST(p_partkey % 3 AS STRING) AS collection",
        "CASE WHEN p_partkey % 10 = 0 THEN 0.4 WHEN p_partkey % 7 = 0 THEN 0.8 ELSE 1.0 END AS confidence",
    ], False),
    "memberships": ("lineitem", ["'pl' || CAST(l_suppkey AS STRING) AS playlist", "'rb:' || CAST(l_partkey AS STRING) AS pid"], True),
    "sets": ("lineitem", ["l_orderkey AS set_id", "l_linenumber AS pos", "'rb:' || CAST(l_partkey AS STRING) AS pid"], False),
    "outcomes": ("events", [
        "event_id", "'rb:' || CAST(1 + user_id % 200 AS STRING) AS pid", "event_type AS status", "value AS raw_tempo", "ts",
        "CASE WHEN event_id % 3 = 0 THEN 'title-only' ELSE 'combined' END AS via",
    ], False),
    #: Recorded lookups: purchases stand for matches; titles carry edition notes and other cases.
    "trial": ("events", [
        "event_id", "'rb:' || CAST(1 + user_id % 400 AS STRING) AS pid", "CASE event_type WHEN 'purchase' THEN 'matched' WHEN 'click' THEN 'http-error' ELSE 'no-match' END AS status",
        "CASE WHEN event_id % 3 = 0 THEN 'title-only' ELSE 'combined' END AS via", "CASE WHEN event_id % 13 = 0 THEN 0.0 ELSE value END AS raw_tempo", "'Song ' || CAST(user_id AS STRING) AS title",
        "CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '米津' ELSE 'Band ' || CAST(user_id % 9 AS STRING) END AS artist",
        "CASE WHEN event_id % 5 = 0 THEN 'Other ' ELSE 'SONG ' END || CAST(user_id AS STRING) || CASE WHEN event_id % 2 = 0 THEN ' (Radio Edit)' ELSE '' END AS matched_title",
        "CASE WHEN event_id % 7 = 0 THEN 'Crew ' ELSE 'band ' END || CAST(user_id % 9 AS STRING) || CASE WHEN event_id % 2 = 0 THEN ' feat. Guest' ELSE '' END AS matched_artist",
        "CASE WHEN event_id % 17 = 0 THEN 'H-dur' WHEN event_id % 4 = 0 THEN NULL ELSE 'Am' END AS key_of", "CASE WHEN event_id % 19 = 0 THEN '13m' WHEN event_id % 6 = 0 THEN NULL ELSE CAST(1 + event_id % 2 AS STRING) || 'm' END AS open_key",
    ], False),
}


def view(spark: SparkSession, sf_dir: str, name: str, repeats: bool = False) -> DataFrame:
    """A view as a DataFrame; only the columns it names reach the scan. With ``repeats``, equal rows stay: for readers
    that tell them by themselves."""
    table, columns, distinct = VIEWS[name]
    found = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)
    return found.distinct() if distinct and not repeats else found


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map points: the first two components of each vector, its label as cluster, label modulo 3 as collection."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr(
        "vec_id AS row_idx", "CAST(embedding[0] AS DOUBLE) AS x", "CAST(embedding[1] AS DOUBLE) AS y", "label AS cluster", "'c' || CAST(label % 3 AS STRING) AS collection"
    )


POINTS_SQL = "points AS (SELECT vec_id AS row_idx, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label AS cluster, 'c' || CAST(label % 3 AS STRING) AS collection FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS row_idx", "embedding AS vec", "label AS cluster", "label % 3 AS collection")


def with_views(*names: str) -> str:
    """The WITH clause of these views for an oracle."""
    parts = []
    for n in names:
        if n == "points":
            parts.append(POINTS_SQL)
        else:
            table, columns, distinct = VIEWS[n]
            parts.append(f"{n} AS (SELECT {'DISTINCT ' if distinct else ''}{', '.join(columns)} FROM {table})")
    return "WITH " + ", ".join(parts)
