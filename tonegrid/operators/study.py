"""Studies over collections and over lookup trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.functions.music import bpm_out_of_range, to_camelot
from tonegrid.functions.text import normalize_artist, normalize_title
from tonegrid.operators.analytics import floor_quantiles, top_terms
from tonegrid.operators.geometry import nearest
from tonegrid.operators.linkage import CJK, MIN_SCORE, match_score


def separation(points: DataFrame, k: int = 15) -> DataFrame:
    """purity (share of a track's k nearest on the map from its own collection), chance, and their separation."""
    flat = points.select("row_idx", F.array("x", "y").alias("vec"))
    of = points.select("row_idx", "collection")
    near = nearest(flat, k=k).join(of.select(F.col("row_idx").alias("query"), F.col("collection").alias("own")), "query").join(of, "row_idx")
    purity = near.groupBy("query").agg(F.avg((F.col("own") == F.col("collection")).cast("double")).alias("p")).agg(F.avg("p").alias("purity"))
    n = of.groupBy("collection").agg(F.count("*").alias("n"))
    chance = n.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("chance"))
    both = purity.crossJoin(F.broadcast(chance))
    return both.select(F.round("purity", 6).alias("purity"), F.round("chance", 6).alias("chance"), F.round((F.col("purity") - F.col("chance")) / (1 - F.col("chance")), 6).alias("separation"))


def composition(points: DataFrame) -> DataFrame:
    """(cluster, collection, n, share, mixed): mixed clusters hold over a tenth of every collection they hold at all."""
    n = points.groupBy("cluster", "collection").agg(F.count("*").alias("n"))
    w = Window.partitionBy("cluster")
    share = F.col("n") / F.sum("n").over(w)
    n = n.withColumn("share", share)
    return n.withColumn("mixed", (F.min("share").over(w) > 0.1) & (F.count("*").over(w) > 1)).withColumn("share", F.round("share", 6))


def mixed_clusters(tracks: DataFrame) -> DataFrame:
    """(cluster, size, median_bpm, genres, examples) of clusters that hold over a tenth of every collection they hold.

    tracks (row_idx, cluster, collection, ...): the floor-index median tempo, the top four genres with their counts, and
    the first track of each collection.
    """
    mixed = composition(tracks).where("mixed").select("cluster").distinct()
    rows = tracks.join(mixed, "cluster")
    size = rows.groupBy("cluster").agg(F.count("*").alias("size"))
    genres = top_terms(rows, "genre", 4, "cluster").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat("term", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t")))).alias("g"))
    example = F.concat("collection", F.lit(": "), F.coalesce("artist", F.lit("?")), F.lit(" — "), "name")
    first = rows.groupBy("cluster", "collection").agg(F.min_by(example, "row_idx").alias("e")).groupBy("cluster").agg(F.array_sort(F.collect_list("e")).alias("examples"))
    tempo = floor_quantiles(rows.where("bpm > 0"), "cluster", "bpm", {"median_bpm": 0.5}).select("cluster", "median_bpm")
    return size.join(tempo, "cluster", "left").join(genres.select("cluster", F.col("g.t").alias("genres")), "cluster", "left").join(first, "cluster")


def size_matched(tracks: DataFrame, seed: int = 42) -> DataFrame:
    """Tracks with every collection cut to the size of the smallest one, by a seeded draw over pids."""
    least = tracks.groupBy("collection").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    drawn = F.row_number().over(Window.partitionBy("collection").orderBy(F.xxhash64(F.lit(seed), "pid"), "pid"))
    return tracks.withColumn("__r", drawn).crossJoin(F.broadcast(least)).where("__r <= least").drop("__r", "least")


def tempo_profile(tracks: DataFrame) -> DataFrame:
    """(collection, n, p25, median, p75, close): floor-index quantiles, and the share within 5 BPM of the median."""
    q = floor_quantiles(tracks, "collection", "bpm", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    near = tracks.where("bpm is not null").join(q.select("collection", "median"), "collection").groupBy("collection").agg(F.avg((F.abs(F.col("bpm") - F.col("median")) <= 5).cast("double")).alias("close"))
    return q.join(near, "collection").withColumn("close", F.round("close", 6))


def common_terms(tracks: DataFrame, term: str, a: str, b: str) -> DataFrame:
    """Terms that both collections have."""
    of = lambda c: tracks.where((F.col("collection") == c) & F.col(term).isNotNull()).select(F.col(term).alias("term"))
    return of(a).intersect(of(b))


def top_by_collection(tracks: DataFrame, term: str, n: int) -> DataFrame:
    return top_terms(tracks, term, n, "collection")


def ablation(fit, blocks: list[str]) -> DataFrame:
    """One row of ``fit(excluded)`` for no exclusion and for each block left out; ``fit`` returns a one-row DataFrame."""
    out = fit(None).withColumn("without", F.lit("nothing"))
    for b in blocks:
        out = out.unionByName(fit(b).withColumn("without", F.lit(b)))
    return out


def with_accepted(outcomes: DataFrame) -> DataFrame:
    """Outcomes with accepted: whether the matcher takes matched_title and matched_artist for the wanted title and artist."""
    forms = {"matched_title": normalize_title, "matched_artist": normalize_artist, "title": normalize_title, "artist": normalize_artist}
    formed = outcomes.withColumns({f"__{c}": F.coalesce(f(F.col(c)), F.lit("")) for c, f in forms.items()})
    return formed.withColumn("accepted", match_score(*(F.col(f"__{c}") for c in forms)) >= MIN_SCORE).drop(*(f"__{c}" for c in forms))


def gated(outcomes: DataFrame, tracks: DataFrame, matched: str = "matched") -> DataFrame:
    """Outcomes with gate: the first one that a recorded lookup fails, or kept.

    outcomes (pid, event_id, status, via, title, artist, matched_title, matched_artist, raw_tempo, key_of, open_key): of
    several for one pid, the first counts and the rest are duplicates. ``matched`` is the status of a match.
    """
    nth = F.row_number().over(Window.partitionBy("pid").orderBy("event_id"))
    met = with_accepted(outcomes).withColumn("nth", nth).join(tracks.select("pid", F.lit(True).alias("known")), "pid", "left")
    key = F.coalesce(to_camelot(F.col("open_key")), to_camelot(F.col("key_of")))
    gate = (
        F.when(F.col("nth") > 1, "duplicate").when(F.col("known").isNull(), "unknown").when(~F.col("status").eqNullSafe(matched), F.concat(F.lit("unmatched:"), F.coalesce("status", F.lit("none"))))
        .when(~F.col("via").eqNullSafe("combined"), "title-only").when(~F.col("accepted"), "refused").when(F.coalesce("raw_tempo", F.lit(0.0)) <= 0, "no-tempo").when(key.isNull(), "no-key").otherwise("kept")
    )
    return met.withColumn("gate", gate).drop("nth", "known", "accepted")


def trial_funnel(outcomes: DataFrame, tracks: DataFrame, matched: str = "matched") -> DataFrame:
    """(gate, n) of recorded lookups."""
    return gated(outcomes, tracks, matched).groupBy("gate").agg(F.count("*").alias("n"))


def refused_examples(outcomes: DataFrame, tracks: DataFrame, matched: str = "matched", limit: int = 12) -> DataFrame:
    """(event_id, example): the first matches that the matcher refuses today."""
    text = F.concat(F.lit('"'), "title", F.lit('" '), F.coalesce("artist", F.lit("?")), F.lit(" → "), F.coalesce("matched_artist", F.lit("?")))
    return gated(outcomes, tracks, matched).where("gate = 'refused'").orderBy("event_id").limit(limit).select("event_id", text.alias("example"))


def lookup_report(outcomes: DataFrame) -> DataFrame:
    """(status, via, n, usable, implausible): counts by status and way, tempos there, and those no record runs at."""
    tempo = F.col("raw_tempo")
    return outcomes.groupBy("status", "via").agg(F.count("*").alias("n"), F.count_if(tempo > 0).alias("usable"), F.count_if((tempo > 0) & bpm_out_of_range(tempo)).alias("implausible"))


def hit_rates(outcomes: DataFrame, matched: str = "matched") -> DataFrame:
    """One row: matches in all, by combined and by title-only lookup, usable values, keys that disagree or fail, matches
    of exact titles across scripts, and tempo quantiles at the floor of q (n - 1)."""
    hit, strict = F.col("status").eqNullSafe(matched), F.col("via").eqNullSafe("combined")
    open_key, key_of = to_camelot(F.col("open_key")), to_camelot(F.col("key_of"))
    tempo, key = F.coalesce(F.col("raw_tempo") > 0, F.lit(False)), F.coalesce(open_key, key_of).isNotNull()
    foreign = lambda c: F.coalesce(normalize_artist(F.col(c)), F.lit("")).rlike(CJK)
    across = F.col("artist").isNotNull() & F.col("matched_artist").isNotNull() & (foreign("artist") != foreign("matched_artist")) & (F.coalesce(normalize_title(F.col("title")), F.lit("")) == F.coalesce(normalize_title(F.col("matched_title")), F.lit("")))
    rows = outcomes.withColumn("across", across)
    share = lambda c: F.round(F.count_if(c) / F.count("*") * 100, 6)
    one = rows.agg(
        F.count("*").alias("n"), F.count_if(hit).alias("matched"), F.count_if(hit & strict).alias("strict"), F.count_if(hit & F.col("via").eqNullSafe("title-only")).alias("fallback"), share(hit).alias("matched_pct"), share(hit & strict).alias("strict_pct"),
        F.count_if(hit & tempo).alias("tempo"), F.count_if(hit & key).alias("key"), F.count_if(hit & strict & tempo).alias("strict_tempo"), F.count_if(hit & strict & key).alias("strict_key"), F.count_if(hit & strict & tempo & key).alias("strict_both"),
        F.count_if(hit & F.col("across")).alias("suspect"), F.count_if(hit & open_key.isNotNull() & key_of.isNotNull() & (open_key != key_of)).alias("disagree"), F.count_if(hit & open_key.isNull() & key_of.isNotNull()).alias("key_of_only"),
    )
    tempos = outcomes.where(hit & tempo).withColumn("all", F.lit(1))
    q = floor_quantiles(tempos, "all", "raw_tempo", {"low": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "high": 1.0}, before_last=True)
    return one.join(q.select("low", "p25", "median", "p75", "high"), F.lit(True), "left")


def failing_spellings(outcomes: DataFrame, matched: str = "matched") -> DataFrame:
    """(field, spelling, n) of keys of matches that are no code."""
    hits = outcomes.where(F.col("status").eqNullSafe(matched))
    each = hits.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("spelling")) for c in ("key_of", "open_key")))).alias("k")).select("k.*")
    return each.where(F.col("spelling").isNotNull() & to_camelot(F.col("spelling")).isNull()).groupBy("field", "spelling").agg(F.count("*").alias("n"))


def trial_cost(outcomes: DataFrame, tracks: DataFrame, requests: int, elapsed_ms: int) -> DataFrame:
    """Requests a track and an hour of a trial, and both carried on to the whole library."""
    n, lib = outcomes.agg(F.count("*").alias("n")), tracks.agg(F.count("*").alias("tracks"))
    per, minutes = requests / F.col("n"), elapsed_ms / 60000 / F.col("n")
    return n.crossJoin(F.broadcast(lib)).select(F.round(per, 6).alias("per_track"), F.lit(round(requests / max(elapsed_ms / 3_600_000, 1e-9))).cast("long").alias("per_hour"), F.round(per * F.col("tracks")).cast("long").alias("all_requests"), F.round(minutes * F.col("tracks")).cast("long").alias("all_minutes"))


def tempo_buckets(outcomes: DataFrame, width: int = 20) -> DataFrame:
    return outcomes.where("raw_tempo > 0").groupBy((F.floor(F.col("raw_tempo") / width) * width).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def key_wheel(tracks: DataFrame) -> DataFrame:
    """(key, n) of all 24 codes, 0 where there is none."""
    slots = tracks.sparkSession.range(24).select(F.concat((F.floor(F.col("id") / 2) + 1).cast("int").cast("string"), F.when(F.col("id") % 2 == 0, "A").otherwise("B")).alias("key"))
    return slots.join(tracks.groupBy(to_camelot(F.col("key")).alias("key")).agg(F.count("*").alias("n")), "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


def lookup_plan(tracks: DataFrame, cache: DataFrame, delay_ms: int) -> DataFrame:
    """Distinct lookup keys, how many the cache serves, and minutes for the rest at one call per ``delay_ms``."""
    keys = tracks.select("lookup_key").distinct().join(cache.select("lookup_key").distinct().withColumn("hit", F.lit(True)), "lookup_key", "left")
    return keys.agg(F.count("*").alias("wanted"), F.count_if("hit").alias("served")).withColumn("minutes", F.round((F.col("wanted") - F.col("served")) * delay_ms / 60000.0, 6))
