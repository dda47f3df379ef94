"""Enrichment: what a track lacks, answers tier by tier, what to keep of them, and the lookup cache."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.functions.music import bpm_suspect, suggest_bpm

# Fields of an answer, days that a miss is remembered.
FIELDS = ("bpm", "key", "preview_url", "tags", "label")
MISS_DAYS = 7


def needs_lookup(bpm: Column, key: Column) -> Column:
    return bpm.isNull() | key.isNull()


def needed_fields(tracks: DataFrame) -> Column:
    """Fields that a lookup could add; a manual value is no gap, and tags only matter without a genre."""
    col = lambda c: F.col(c) if c in tracks.columns else F.lit(None).cast("string")
    manual = lambda c: F.coalesce(col(c) == "manual", F.lit(False))
    no_tags = F.coalesce(F.size(F.col("tags")), F.lit(0)) <= 0 if "tags" in tracks.columns else F.lit(True)
    return F.array_compact(F.array(
        F.when(col("bpm").isNull() & ~manual("source_bpm"), "bpm"), F.when(col("key").isNull() & ~manual("source_key"), "key"),
        F.when(col("preview_url").isNull(), "preview_url"), F.when(col("label").isNull(), "label"), F.when(col("genre").isNull() & no_tags, "tags"),
    ))


def outstanding(need: Column, have: Column, covered: Column) -> Column:
    """Needed fields that are neither there nor settled by an earlier pass."""
    return F.array_except(F.array_except(need, have), F.coalesce(covered, F.array().cast("array<string>")))


def work_list(tracks: DataFrame, visible: DataFrame, focused: DataFrame) -> DataFrame:
    """(pid, rank, pos): what is in view first, then what is focused, then the rest, in row order."""
    return ranked_work(tracks.where(needs_lookup(F.col("bpm"), F.col("key"))), visible, focused)


def ranked_work(wanted: DataFrame, visible: DataFrame, focused: DataFrame) -> DataFrame:
    """(pid, rank, row_idx) of ``wanted`` tracks in the order of ``work_list``, whatever makes them wanted."""
    mark = lambda f, name: f.select("pid").distinct().withColumn(name, F.lit(True))
    rows = wanted.join(mark(visible, "v"), "pid", "left").join(mark(focused, "f"), "pid", "left")
    rank = F.when(F.col("v"), 0).when(F.col("f"), 1).otherwise(2)
    return rows.select("pid", rank.alias("rank"), "row_idx").orderBy("rank", "row_idx")


#: What a lookup queue is told. A track states what it needs (the latest statement counts); a lookup states its status (hit,
#: miss or error), the fields that it asked for (covered) and those that it brought (have).
LOOKUP_EVENTS = "pid string, ts timestamp, need array<string>, status string, covered array<string>, have array<string>"


def lookup_states(events: DataFrame) -> DataFrame:
    """One row per pid of ``LOOKUP_EVENTS``: need, done (fields that a hit brought or asked for) and, for each field, when it
    was last missed (missed, in the order of ``FIELDS``; null: never).

    Sums of its events that do not depend on their order, of fixed size, so the same expression is a batch aggregate and
    the state of a stream. An error leaves no trace; rows without a pid are no track's.
    """
    holds = lambda c, f: F.coalesce(F.array_contains(c, f), F.lit(False))
    need = F.max_by("need", F.when(F.col("need").isNotNull(), F.struct("ts", F.array_sort("need").alias("n"))))
    found = [F.coalesce(F.bool_or((F.col("status") == "hit") & (holds("covered", f) | holds("have", f))), F.lit(False)).alias(f"d_{f}") for f in FIELDS]
    missed = [F.max(F.when((F.col("status") == "miss") & holds("covered", f), F.col("ts"))).alias(f"m_{f}") for f in FIELDS]
    states = events.where("pid is not null").groupBy("pid").agg(need.alias("need"), *found, *missed)
    done = F.array_compact(F.array(*(F.when(F.col(f"d_{f}"), f) for f in FIELDS)))
    return states.select("pid", "need", done.alias("done"), F.array(*(f"m_{f}" for f in FIELDS)).alias("missed"))


def outstanding_lookups(states: DataFrame, now: Column) -> DataFrame:
    """(pid, outstanding) of ``lookup_states`` with fields left to look up: needed, not done, and not missed within a week."""
    live = F.array_compact(F.array(*(F.when(F.get("missed", i) > now - F.expr(f"INTERVAL {MISS_DAYS} DAYS"), f) for i, f in enumerate(FIELDS))))
    left = outstanding(F.coalesce("need", F.array().cast("array<string>")), F.col("done"), live)
    return states.select("pid", left.alias("outstanding")).where("size(outstanding) > 0")


def analysis_targets(tracks: DataFrame, visible: DataFrame) -> DataFrame:
    """(pid, audio, lookup) of visible tracks that lack sound features or tempo and key, or could be looked up."""
    rows = tracks.join(visible.select("pid").distinct(), "pid", "left_semi")
    timbre = F.col("timbre").isNull() if "timbre" in tracks.columns else F.lit(True)
    flags = rows.select("pid", "row_idx", (timbre | needs_lookup(F.col("bpm"), F.col("key"))).alias("audio"), (needs_lookup(F.col("bpm"), F.col("key")) | F.col("label").isNull()).alias("lookup"))
    return flags.where("audio or lookup")


@dataclass(frozen=True)
class Tier:
    """A catalogue: answers (lookup_key, status: hit, miss or error, and fields it provides)."""

    name: str
    provides: tuple[str, ...]
    answers: DataFrame


def cascade(wanted: DataFrame, tiers: list[Tier]) -> DataFrame:
    """Answers for wanted (lookup_key, need, covered) from the tiers in order.

    A tier is asked if it provides a needed field that neither an earlier tier of this pass has found nor an earlier
    pass has settled; it covers what it provides unless it failed. The first to state a field wins. Adds the fields,
    source, covered_now and, per tier, its status (null: skipped).
    """
    out = wanted.withColumn("covered_now", F.coalesce("covered", F.array().cast("array<string>"))).withColumn("source", F.lit(None).cast("string"))
    for f in FIELDS:
        out = out.withColumn(f, F.lit(None).cast({"bpm": "double", "tags": "array<string>"}.get(f, "string")))
    for t in tiers:
        have = F.array_compact(F.array(*(F.when(F.size("tags") > 0 if f == "tags" else F.col(f).isNotNull(), f) for f in FIELDS)))
        asked = F.arrays_overlap(outstanding(F.col("need"), have, F.col("covered")), F.array(*map(F.lit, t.provides)))
        kept = [f for f in FIELDS if f in t.provides and f in t.answers.columns]
        got = t.answers.select("lookup_key", F.col("status").alias("__status"), *(F.col(f).alias(f"__{f}") for f in kept))
        out = out.join(got, "lookup_key", "left").withColumn("__asked", asked)
        status = F.when(F.col("__asked"), F.coalesce("__status", F.lit("miss")))
        hit = F.coalesce(status == "hit", F.lit(False))
        fresh = F.lit(False)
        for f in ("bpm", "key"):
            if f in kept:
                fresh = fresh | (hit & F.col(f).isNull() & F.col(f"__{f}").isNotNull())
        out = out.withColumn("source", F.when(fresh, F.concat_ws("+", "source", F.lit(t.name))).otherwise(F.col("source")))
        for f in kept:
            value = F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("__tags", F.array().cast("array<string>"))) if f == "tags" else F.coalesce(f, f"__{f}")
            out = out.withColumn(f, F.when(hit, value).otherwise(F.col(f)))
        covers = F.coalesce(status.isin("hit", "miss"), F.lit(False))
        out = out.withColumn("covered_now", F.when(covers, F.array_union("covered_now", F.array(*map(F.lit, t.provides)))).otherwise(F.col("covered_now")))
        out = out.withColumn(f"status_{t.name}", status).drop("__status", "__asked", *(f"__{f}" for f in kept))
    return out


def source_tallies(cascaded: DataFrame, names: list[str]) -> DataFrame:
    """(source, calls, hits, misses, errors, skipped) of each tier, from one pass."""
    n = len(names)
    stacked = cascaded.select(F.expr(f"stack({n}, " + ", ".join(f"'{t}', status_{t}" for t in names) + ") as (source, status)"))
    count = lambda s: F.count_if(F.col("status") == s)
    return stacked.groupBy("source").agg(F.count("status").alias("calls"), count("hit").alias("hits"), count("miss").alias("misses"), count("error").alias("errors"), F.count_if(F.col("status").isNull()).alias("skipped"))


def _manual(tracks: DataFrame, field: str) -> Column:
    source = f"source_{field}"
    return F.coalesce(F.col(source) == "manual", F.lit(False)) if source in tracks.columns else F.lit(False)


def _updated(tracks: DataFrame, met: DataFrame, values: dict[str, Column]) -> DataFrame:
    """The columns of tracks and those new ones, with the given values in place of what they name."""
    return met.select(*(values[c].alias(c) if c in values else F.col(c) for c in tracks.columns), *(v.alias(c) for c, v in values.items() if c not in tracks.columns))


def _kept(tracks: DataFrame, column: str, kind: str = "string") -> Column:
    return F.col(column) if column in tracks.columns else F.lit(None).cast(kind)


def apply_answers(tracks: DataFrame, answers: DataFrame, *order: str) -> DataFrame:
    """Tracks with what answers (pid, bpm, key, label, source and, if there, preview_url, catalogue_id, tags,
    bpm_confidence, key_confidence) add: only what is missing and not manual; tags unite.

    Of several answers for one pid, the first by ``order`` that states a field gives it (the smallest value on ties).
    Adds the source and confidence of what was taken, changed, and bpm_suspect for a tempo no record runs at or that a
    genre makes doubtful.
    """
    has = [c for c in ("bpm", "key", "label", "preview_url", "catalogue_id") if c in answers.columns]
    stated = lambda c: F.struct(F.col(c).alias("value"), F.col("source"), (F.col(f"{c}_confidence") if f"{c}_confidence" in answers.columns else F.lit(None).cast("double")).alias("confidence"))
    picks = [F.min_by(stated(c), F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("__v"), "source"))).alias(f"a_{c}") for c in has]
    if "tags" in answers.columns:
        picks.append(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("tags").alias("__t")))), lambda x: F.coalesce(x["__t"], F.array().cast("array<string>")))).alias("a_tags"))
    met = tracks.join(answers.groupBy("pid").agg(*picks), "pid", "left")
    takes = {c: _kept(tracks, c).isNull() & F.col(f"a_{c}.value").isNotNull() & ~_manual(tracks, c) for c in has}
    values = {c: F.when(takes[c], F.col(f"a_{c}.value")).otherwise(_kept(tracks, c, dict(answers.dtypes)[c])) for c in has}
    for c in ("bpm", "key", "label"):
        if c in has:
            values[f"source_{c}"] = F.when(takes[c], F.col(f"a_{c}.source")).otherwise(_kept(tracks, f"source_{c}"))
    for c in ("bpm", "key"):
        if f"{c}_confidence" in answers.columns:
            values[f"{c}_confidence"] = F.when(takes[c], F.col(f"a_{c}.confidence")).otherwise(_kept(tracks, f"{c}_confidence", "double"))
    changed = [*takes.values()]
    if "tags" in answers.columns:
        values["tags"] = F.when(F.size("a_tags") > 0, F.array_distinct(F.concat(F.coalesce(_kept(tracks, "tags", "array<string>"), F.array().cast("array<string>")), "a_tags"))).otherwise(_kept(tracks, "tags", "array<string>"))
        changed.append(F.coalesce(F.size("a_tags") > 0, F.lit(False)))
    doubt = F.coalesce(takes["bpm"] & bpm_suspect(F.col("a_bpm.value"), F.col("genre")), F.lit(False)) if "bpm" in has else F.lit(False)
    values["changed"] = reduce(or_, changed)
    values["bpm_suspect"] = F.coalesce(_kept(tracks, "bpm_suspect", "boolean"), F.lit(False)) | doubt
    return _updated(tracks, met, values)


def apply_audio(tracks: DataFrame, results: DataFrame) -> DataFrame:
    """Tracks with tempo and key of results (pid, bpm, key, ambiguous, timbre) where they lack them and none is manual.

    An ambiguous tempo, or one that the genre makes doubtful, is suspect. A timbre always lands; a track without a
    result, or whose result has none, keeps its own. One result for each pid.
    """
    got = results.select("pid", F.col("bpm").alias("a_bpm"), F.col("key").alias("a_key"), "ambiguous", F.col("timbre").alias("a_timbre"))
    met = tracks.join(got, "pid", "left")
    takes = {c: F.col(c).isNull() & F.col(f"a_{c}").isNotNull() & ~_manual(tracks, c) for c in ("bpm", "key")}
    takes["bpm"] = F.coalesce(takes["bpm"] & (F.col("a_bpm") > 0), F.lit(False))
    sounds = F.coalesce(F.size("a_timbre") > 0, F.lit(False))
    doubt = takes["bpm"] & (F.coalesce("ambiguous", F.lit(False)) | suggest_bpm(F.col("a_bpm"), _kept(tracks, "genre")).isNotNull())
    values = {c: F.when(takes[c], F.col(f"a_{c}")).otherwise(F.col(c)) for c in takes}
    values |= {f"source_{c}": F.when(takes[c], "dsp").otherwise(_kept(tracks, f"source_{c}")) for c in takes}
    values["timbre"] = F.when(sounds, F.col("a_timbre")).otherwise(_kept(tracks, "timbre", dict(results.dtypes)["timbre"]))
    values["bpm_suspect"] = F.coalesce(_kept(tracks, "bpm_suspect", "boolean"), F.lit(False)) | doubt
    values["changed"] = takes["bpm"] | takes["key"] | sounds
    return _updated(tracks, met, values)


def read_cache(wanted: DataFrame, cache: DataFrame, now: Column, version: int) -> DataFrame:
    """(lookup_key, served): cache rows (lookup_key, v, ts, hit, covered, have) of the version; misses end after a week.

    A row without ``covered`` answers for every field; one is served only if no needed field is outstanding.
    """
    live = cache.where((F.col("v") == version) & (F.col("hit") | (F.col("ts") > now - F.expr(f"INTERVAL {MISS_DAYS} DAYS"))))
    met = wanted.join(live.select("lookup_key", "covered", "have", F.lit(True).alias("found")), "lookup_key", "left")
    left = outstanding(F.col("need"), F.coalesce("have", F.array().cast("array<string>")), F.coalesce("covered", F.array(*map(F.lit, FIELDS))))
    return met.select("lookup_key", (F.coalesce("found", F.lit(False)) & (F.size(left) == 0)).alias("served"))


def write_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The latest row of each key."""
    rank = F.row_number().over(Window.partitionBy("lookup_key").orderBy(F.desc("ts")))
    return cache.unionByName(fresh).withColumn("__r", rank).where("__r = 1").drop("__r")


def purge_misses(cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays, and how many misses went."""
    return cache.where("hit"), cache.agg(F.count_if(~F.col("hit")).alias("removed"))
