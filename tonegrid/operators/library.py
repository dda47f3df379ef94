"""Libraries as tables: identity, union, removal, sampling and playlist rules.

tracks(pid, row_idx, collection, ...), memberships(playlist, pid), playlists(playlist, pos), collections(id, label, pos).
Every function is DataFrames in, DataFrames out; rows meet on pid or playlist only.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.functions.text import hash_64
from tonegrid.operators.lineage import dealt

#: Playlists that players make by themselves (fixed values).
RESERVED = ("Library", "Music", "Downloaded", "Recently Added")
SAMPLE_SIZES, SAMPLE_OFFER = (500, 1000, 2000), 1000


def keep_first(frame: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def export_pid(location: Column, artist: Column, name: Column, track_id: Column) -> Column:
    """A durable id: hash of the path, else of artist and name, else of the row id."""
    named = F.concat(F.coalesce(artist, F.lit("")), F.lit("|"), F.coalesce(name, F.lit("")))
    basis = F.coalesce(F.nullif(location, F.lit("")), F.when(named != "|", named), F.concat(F.lit("id:"), track_id.cast("string")))
    return F.concat(F.lit("rb:"), hash_64(basis))


def text_export_pids(rows: DataFrame, columns: list[str], line: str = "line") -> DataFrame:
    """pid of rows of a text export: hash of all columns; where that repeats, hashed again with the line number."""
    joined = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    hashed = rows.withColumn("__basis", joined).withColumn("pid", F.concat(F.lit("rbtxt:"), hash_64(F.col("__basis"))))
    again = F.row_number().over(Window.partitionBy("pid").orderBy(line)) > 1
    hashed = hashed.withColumn("__again", again)
    renewed = F.concat(F.lit("rbtxt:"), hash_64(F.concat(F.col("__basis"), F.lit("\tline:"), F.col(line).cast("string"))))
    return hashed.withColumn("pid", F.when(F.col("__again"), renewed).otherwise(F.col("pid"))).drop("__basis", "__again")


def is_sampler_shot(duration_ms: Column, bpm: Column) -> Column:
    return (duration_ms > 0) & (duration_ms < 30_000) & bpm.isNull()


def import_stats(rows: DataFrame, *keys: str) -> DataFrame:
    """declared, parsed (named), skipped (unnamed or one-shots), with_bpm, with_key of each file."""
    shot, named = F.coalesce(is_sampler_shot(F.col("duration_ms"), F.col("bpm")), F.lit(False)), F.col("name").isNotNull()
    kept = named & ~shot
    return rows.groupBy(*keys).agg(
        F.count("*").alias("declared"), F.count_if(kept).alias("parsed"), F.count_if(~kept).alias("skipped"),
        F.count_if(kept & F.col("bpm").isNotNull()).alias("with_bpm"), F.count_if(kept & F.col("key").isNotNull()).alias("with_key"),
    )


def join_playlist_refs(refs: DataFrame, tracks: DataFrame) -> DataFrame:
    """(file, playlist, pid, pos) of refs (file, playlist, key_type, key, pos) that meet a track by id or by location.

    Of tracks with one id the last counts; id 0 is none; a repeat within a playlist counts once, at its first place.
    Refs and tracks meet in tasks of bounded rows; no side goes whole to a task.
    """
    n = refs.count()
    size = n + 2 * tracks.count()
    ref = lambda kind, key: F.concat(kind.cast("string"), F.lit(":"), key).alias("ref")  # noqa: E731  one column, so that a constant kind leaves the dealing as it is
    by_id = tracks.where("track_id <> 0").select("file", ref(F.lit(0), F.col("track_id").cast("string")), "pid", "row_idx")
    by_place = tracks.where("location is not null").select("file", ref(F.lit(1), F.col("location")), "pid", "row_idx")
    one = ["file", "ref"]
    known = dealt(by_id.unionByName(by_place), size, *one).groupBy(*one).agg(F.max_by("pid", "row_idx").alias("pid"))
    met = dealt(refs.select("file", "playlist", ref(F.col("key_type"), F.col("key")), "pos"), size, *one).hint("merge").join(known, one)
    return dealt(met.select("file", "playlist", "pid", "pos"), n, "file", "playlist", "pid").groupBy("file", "playlist", "pid").agg(F.min("pos").alias("pos"))


def join_playlist_items(items: DataFrame, tracks: DataFrame) -> DataFrame:
    """(file, playlist, pid, pos) of items (file, playlist, track_id, pos) that meet a track; repeats stay.

    Of tracks with one id in a file, the last counts. Items and tracks meet in tasks of bounded rows.
    """
    size, one = items.count() + tracks.count(), ["file", "track_id"]
    by_id = dealt(tracks.select(*one, "pid", "row_idx"), size, *one).groupBy(*one).agg(F.max_by("pid", "row_idx").alias("pid"))
    return dealt(items, size, *one).hint("merge").join(by_id, one).select("file", "playlist", "pid", "pos")


def filter_playlists(playlists: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of playlists (file, playlist, pos, master, distinguished) with items (file, playlist, track_id).

    The master list, distinguished and reserved ones, empty ones, and repeats of an earlier one's members go. Lists the
    player makes by itself are gone before members are gathered.
    """
    own = playlists.where(~(F.coalesce("master", F.lit(False)) | F.col("distinguished").isNotNull() | F.col("playlist").isin(*RESERVED)))
    members = items.join(own.select("file", "playlist"), ["file", "playlist"], "left_semi")
    # two order-free sums of hashes and a count tell multisets of members apart without gathering them
    sums = [F.sum(F.xxhash64(F.lit(salt), F.hash("track_id"), "track_id").cast("decimal(20,0)")).cast("string") for salt in (1, 2)]
    signature = members.groupBy("file", "playlist").agg(F.concat_ws(":", F.count("*").cast("string"), *sums).alias("signature"))
    kept = keep_first(own.join(signature, ["file", "playlist"]), ["file", "signature"], F.col("pos")).drop("signature")
    return kept, playlists.join(kept, ["file", "playlist"], "left_anti")


def slug(label: Column) -> Column:
    s = F.regexp_replace(F.lower(label), r"\.[a-z0-9]+$", "")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("collection"))


def free_numbers(wanted: DataFrame, used: DataFrame) -> DataFrame:
    """``wanted`` (stem) with ``i``: the smallest number from 1 on that ``used`` (stem, i) does not hold for the stem."""
    held = used.groupBy("stem").agg(F.collect_set("i").alias("held"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("held") + 1), "held"))
    return wanted.join(held, "stem", "left").withColumn("i", F.coalesce(F.when(F.col("held").isNotNull(), free), F.lit(1))).drop("held")


def unique_ids(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, free) of wanted ids: the id itself, or the first of ``id-2``, ``id-3``, ... that is not taken."""
    numbered = taken.select(F.regexp_extract("id", r"^(.*)-(\d+)$", 1).alias("stem"), F.regexp_extract("id", r"^(.*)-(\d+)$", 2).try_cast("int").alias("i")).where("i >= 2")
    used = taken.select(F.col("id").alias("stem"), F.lit(1).alias("i")).unionByName(numbered)
    found = free_numbers(wanted.select(F.col("id").alias("stem")).distinct(), used)
    return found.select(F.col("stem").alias("id"), F.when(F.col("i") == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("-"), F.col("i").cast("string"))).alias("free"))


def merge_tracks(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union in import order: a known pid keeps its first row."""
    both = base.withColumn("__side", F.lit(0)).unionByName(incoming.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, ["pid"], F.col("__side"), F.col("row_idx")).drop("__side")


def merge_report(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """added, duplicate_pids and redundant (nothing is new) of a union."""
    known = base.select("pid").distinct().withColumn("known", F.lit(True))
    met = incoming.select("pid").distinct().join(known, "pid", "left")
    return met.agg(F.count_if(F.col("known").isNull()).alias("added"), F.count_if("known").alias("duplicate_pids")).withColumn("redundant", F.col("added") == 0)


def rename_clashing(incoming: DataFrame, taken: DataFrame, label: str) -> DataFrame:
    """(playlist, free) for incoming playlists: ``name [label]``, ``name [label 2]``, ... where the name is taken."""
    clash = incoming.select("playlist").distinct().join(taken.select("playlist").distinct(), "playlist", "left_semi")
    pattern = rf"^(.*) \[{re.escape(label)}(?: (\d+))?\]$"
    number = F.coalesce(F.regexp_extract("playlist", pattern, 2).try_cast("int"), F.lit(1))
    used = taken.where(F.col("playlist").rlike(pattern)).select(F.regexp_extract("playlist", pattern, 1).alias("stem"), number.alias("i"))
    found = free_numbers(clash.select(F.col("playlist").alias("stem")), used)
    mark = F.when(F.col("i") == 1, F.lit(f" [{label}]")).otherwise(F.concat(F.lit(f" [{label} "), F.col("i").cast("string"), F.lit("]")))
    return found.select(F.col("stem").alias("playlist"), F.concat("stem", mark).alias("free"))


def different(memberships: DataFrame, rows: int | None = None) -> DataFrame:
    """(playlist, pid) without repeats; with ``rows``, about how many there are, dealt in tasks of bounded rows before."""
    pairs = memberships.select("playlist", "pid")
    return (pairs if rows is None else dealt(pairs, rows, "playlist", "pid")).distinct()


def merge_memberships(base: DataFrame, incoming: DataFrame, renamed: DataFrame, rows: int | None = None) -> DataFrame:
    """All memberships under their final names; a known track inherits the incoming playlists. Repeats count once.

    ``rows`` says about how many memberships there are on both sides. They are then dealt before repeats are found, in
    tasks of bounded rows: nearly all differ, so to look for repeats earlier would hold all rows of a task for nothing.
    """
    moved = incoming.join(renamed, "playlist", "left").select(F.coalesce("free", "playlist").alias("playlist"), "pid")
    return different(base.select("playlist", "pid").unionByName(moved), rows)


class Library(NamedTuple):
    """tracks (pid, row_idx, collection, ...), memberships (playlist, pid) and collections (id, label, pos, track_count, ...)."""

    tracks: DataFrame
    memberships: DataFrame
    collections: DataFrame


def additions(base: Library, incoming: Library, label: str, rows: int | None = None) -> Library | None:
    """What ``incoming`` adds to ``base``: tracks of new pids, memberships that are not there under their final names, and
    collections behind those of ``base``. None where no pid is new. ``rows`` as in ``merge``."""
    new = keep_first(incoming.tracks.join(base.tracks.select("pid"), "pid", "left_anti"), ["pid"], F.col("row_idx"))
    if new.isEmpty():
        return None
    renamed = rename_clashing(incoming.memberships, base.memberships, label)
    moved = merge_memberships(base.memberships.limit(0), incoming.memberships, renamed, rows)
    last = base.collections.agg(F.max("pos")).first()[0]
    after = incoming.collections.withColumn("pos", F.col("pos") + F.lit(0 if last is None else last + 1))
    known = base.memberships if rows is None else different(base.memberships, rows)
    return Library(new, moved.join(known, ["playlist", "pid"], "left_anti"), after)


def recounted(collections: DataFrame, tracks: DataFrame) -> DataFrame:
    """Collections with the number of tracks that they own; one that owns none keeps its count."""
    counted = tracks.groupBy(F.col("collection").alias("id")).agg(F.count("*").alias("n"))
    return collections.join(counted, "id", "left").withColumn("track_count", F.coalesce("n", "track_count")).drop("n")


def merge(base: Library, incoming: Library, label: str, rows: int | None = None) -> Library:
    """The union of two libraries in import order, or ``base`` untouched where ``incoming`` has no new pid.

    A known pid keeps its first row and inherits the incoming playlists. A playlist whose name is taken gets ``label``
    behind it. Collections of ``incoming`` follow those of ``base``, and all are counted anew; one that owns no track
    keeps its count. ``rows`` says about how many memberships there are, so that they meet in tasks of bounded rows.
    """
    more = additions(base, incoming, label, rows)
    if more is None:
        return base
    tracks = merge_tracks(base.tracks, more.tracks)
    members = different(base.memberships, rows).unionByName(more.memberships)
    return Library(tracks, members, recounted(base.collections.unionByName(more.collections, allowMissingColumns=True), tracks))


def track_counts(collections: DataFrame, tracks: DataFrame) -> DataFrame:
    n = tracks.groupBy(F.col("collection").alias("id")).agg(F.count("*").alias("track_count"))
    return collections.drop("track_count").join(n, "id", "left").fillna(0, ["track_count"])


def restrict(tracks: DataFrame, memberships: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracks and memberships of the pids in ``keep``; playlists left without a member vanish with their rows."""
    pids = keep.select("pid").distinct()
    return tracks.join(pids, "pid", "left_semi"), memberships.join(pids, "pid", "left_semi")


def remove_collection(tracks: DataFrame, memberships: DataFrame, collection: str) -> tuple[DataFrame, DataFrame]:
    gone = tracks.where(F.col("collection") == collection).select("pid").distinct()
    return tracks.join(gone, "pid", "left_anti"), memberships.join(gone, "pid", "left_anti")


def sample(tracks: DataFrame, size: int, seed: int = 42, exclude: DataFrame | None = None) -> DataFrame:
    """Exactly ``size`` tracks (all, if there are no more), uniform over pids, the same for one seed."""
    rows = tracks if exclude is None else tracks.join(exclude.select("pid").distinct(), "pid", "left_anti")
    return rows.orderBy(F.xxhash64(F.lit(seed), "pid"), "pid").limit(size)


def downsample_library(tracks: DataFrame, memberships: DataFrame, size: int, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tracks, memberships, emptied): a uniform sample, playlists narrowed to it, and the playlists it left empty.

    ``size`` or fewer tracks stay as they are. A playlist column of tracks (array) loses the emptied names and no others.
    """
    if tracks.limit(size + 1).count() <= size:
        return tracks, memberships, memberships.select("playlist").limit(0)
    kept = sample(tracks, size, seed)
    narrowed = memberships.join(kept.select("pid").distinct(), "pid", "left_semi")
    emptied = memberships.select("playlist").distinct().join(narrowed.select("playlist").distinct(), "playlist", "left_anti")
    if "playlists" in tracks.columns:
        named = kept.select("pid", F.posexplode_outer("playlists").alias("n", "playlist")).join(emptied.withColumn("gone", F.lit(True)), "playlist", "left").where("gone is null")
        lists = named.groupBy("pid").agg(F.array_sort(F.collect_list(F.when(F.col("playlist").isNotNull(), F.struct("n", "playlist")))).alias("l"))
        kept = kept.join(lists, "pid", "left").withColumn("playlists", F.coalesce("l.playlist", F.array().cast("array<string>"))).drop("l")
    return kept, narrowed, emptied


def exclusion_report(tracks: DataFrame, exclude: DataFrame) -> DataFrame:
    """(excluded, unknown, eligible): excluded pids, those of no track, and the tracks that are left."""
    known = tracks.select("pid").distinct().withColumn("known", F.lit(True))
    gone = exclude.select("pid").distinct().join(known, "pid", "left").agg(F.count("*").alias("excluded"), F.count_if(F.col("known").isNull()).alias("unknown"))
    left = tracks.join(exclude.select("pid").distinct(), "pid", "left_anti").agg(F.count("*").alias("eligible"))
    return gone.crossJoin(F.broadcast(left))


def tag_collection(tracks: DataFrame, collection: str) -> DataFrame:
    """Every track of a freshly read library in its collection."""
    return tracks.withColumn("collection", F.lit(collection))


def ensure_collections(tracks: DataFrame, collections: DataFrame, fallback: str = "Imported library") -> tuple[DataFrame, DataFrame]:
    """Tracks that all have a collection, and collections (id, label, pos, format, track_count) with one entry at least.

    Tracks without one join the first collection; where there is none, one is made of ``fallback``, whose format the
    pids tell.
    """
    format_ = F.when(F.bool_or(F.col("pid").startswith("rbtxt:")), "rekordbox-txt").when(F.bool_or(F.col("pid").startswith("rb:")), "rekordbox").otherwise("apple")
    made = tracks.agg(F.count("*").alias("track_count"), format_.alias("format")).select(slug(F.lit(fallback)).alias("id"), F.lit(fallback).alias("label"), F.lit(0).alias("pos"), "format", "track_count")
    given = collections.agg(F.count("*").alias("given"))
    known = collections.select("id", "label", "pos", "format", "track_count").unionByName(made.crossJoin(F.broadcast(given)).where("given = 0").drop("given"))
    first = known.agg(F.min_by("id", "pos").alias("first"))
    return tracks.crossJoin(F.broadcast(first)).withColumn("collection", F.coalesce("collection", "first")).drop("first"), known


def sample_presets(n: Column) -> Column:
    return F.filter(F.array(*map(F.lit, SAMPLE_SIZES)), lambda x: x < n)


def apply_overrides(tracks: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual bpm and key of overrides (pid, bpm, key, ts) win; of several, the latest that states the field.

    A field that is set gets the source manual and confidence 1, and a tempo that is set is no longer suspect. Everything
    else stays as it is: sources and confidences (source_bpm, source_key, confidence_bpm, confidence_key; null where tracks
    have no such column) of other tracks and other fields, and bpm_suspect. A bpm of 0 or an empty key sets nothing.
    """
    stated = overrides.select("pid", "ts", F.when(F.col("bpm") > 0, F.col("bpm")).alias("bpm"), F.when(F.col("key") != "", F.col("key")).alias("key"))
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(f"_{c}")
    out = tracks.join(stated.groupBy("pid").agg(newest("bpm"), newest("key")), "pid", "left")
    old = lambda c, kind: F.col(c) if c in tracks.columns else F.lit(None).cast(kind)
    for c in ("bpm", "key"):
        there = F.col(f"_{c}").isNotNull()
        out = out.withColumns({
            c: F.coalesce(f"_{c}", c),
            f"source_{c}": F.when(there, "manual").otherwise(old(f"source_{c}", "string")),
            f"confidence_{c}": F.when(there, 1.0).otherwise(old(f"confidence_{c}", "double")),
        })
    if "bpm_suspect" in tracks.columns:
        out = out.withColumn("bpm_suspect", F.when(F.col("_bpm").isNotNull(), F.lit(False)).otherwise(F.col("bpm_suspect")))
    return out.drop("_bpm", "_key")
