"""Record linkage: catalogue candidates for wanted tracks, local duplicates, files for exported paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrid.functions.text import decode_location, fold_segment, path_segments

# Least score of a match, letters that must agree, scripts that cannot be compared with others.
MIN_SCORE, SHARED, CONTAINED = 2, 12, 4
CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]"


def contains_word(hay: Column, needle: Column) -> Column:
    """Whether ``needle`` stands in ``hay`` with no letter or digit right beside it, at any of its places."""
    marked = F.concat(F.lit(" "), hay, F.lit(" "))
    parts = F.split(marked, F.concat(F.lit(r"\Q"), needle, F.lit(r"\E")), -1)
    edges = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    touch = lambda i: ~F.get(parts, i - 1).rlike(r"[\p{L}\p{N}]$") & ~F.get(parts, i).rlike(r"^[\p{L}\p{N}]") & (F.get(parts, i - 1) != "") & (F.get(parts, i) != "")
    return (F.size(parts) > 1) & F.exists(edges, touch)


def match_score(c_title: Column, c_artist: Column, w_title: Column, w_artist: Column) -> Column:
    """0 to 4 over normal forms: the title counts up to 2 and must agree; a known artist must too, unless the scripts
    differ, where an exact title gives 3."""
    n = F.least(F.lit(SHARED), F.length(c_title), F.length(w_title))
    title = F.when(c_title == w_title, 2).when((n >= CONTAINED) & (F.substring(c_title, F.lit(1), n) == F.substring(w_title, F.lit(1), n)), 1).otherwise(0)
    missing = (F.coalesce(c_artist, F.lit("")) == "") | (F.coalesce(w_artist, F.lit("")) == "")
    apart = c_artist.rlike(CJK) != w_artist.rlike(CJK)
    shorter, longer = F.when(F.length(c_artist) <= F.length(w_artist), c_artist).otherwise(w_artist), F.when(F.length(c_artist) <= F.length(w_artist), w_artist).otherwise(c_artist)
    artist = F.when(c_artist == w_artist, 2).when((F.length(shorter) >= CONTAINED) & contains_word(longer, shorter), 1).otherwise(0)
    known = F.when(apart, F.when(title == 2, 3).otherwise(0)).when(artist == 0, 0).otherwise(title + artist)
    return F.when(title == 0, 0).when(missing, title).otherwise(known)


def match_candidates(wanted: DataFrame, candidates: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """(want_id, cand_id, score): the best candidate of each wanted row, the earliest on ties.

    wanted (want_id, title, artist) and candidates (cand_id, pos, title, artist) hold normal forms. Titles that score
    agree in all letters of the shorter one, or in the first twelve, so each side is met at the other's own length: only
    titles with the same twelve letters, or one that is the beginning of the other, are ever compared. Within such titles,
    artists that score are equal or one stands in the other, so the rarest word of the one is a word of the other; pairs meet
    on both keys, and a title that thousands share makes no square. Where the artist decides nothing (one is missing, or
    the scripts can't be compared) only the first candidate of a title and kind of artist can win. Equal (title,
    artist) pairs are scored once, and only the first of equal candidates can win.
    """
    w = wanted.groupBy("title", "artist").agg(F.count("*").alias("n")).select(F.col("title").alias("w_title"), F.col("artist").alias("w_artist"))
    c = candidates.groupBy("title", "artist").agg(F.min_by("cand_id", "pos").alias("cand_id"), F.min("pos").alias("pos")).select(F.col("title").alias("c_title"), F.col("artist").alias("c_artist"), "cand_id", "pos")
    cols = ["w_title", "w_artist", "c_title", "c_artist", "cand_id", "pos"]

    rare = _rarest_words(w.select(F.col("w_artist").alias("artist")).union(c.select("c_artist")))
    w_known = _named(_keyed(w.where(F.col("w_artist") != ""), "w_title", "short_w", "short_c"), "w_artist", rare, "in_c", "in_w")
    c_known = _named(_keyed(c.where(F.col("c_artist") != ""), "c_title", "short_c", "short_w"), "c_artist", rare, "in_w", "in_c")
    met = w_known.join(c_known, ["key", "word"]).select(cols)

    kind = lambda artist: F.when(F.coalesce(artist, F.lit("")) == "", "missing").when(artist.rlike(CJK), "cjk").otherwise("other")
    first = F.min_by(F.struct("c_artist", "cand_id", "pos"), "pos").alias("f")
    firsts = c.withColumn("kind", F.explode(F.array(kind(F.col("c_artist")), F.lit("any")))).groupBy("c_title", "kind").agg(first).select("c_title", "kind", "f.*")
    asks = F.when(kind(F.col("w_artist")) == "missing", F.array(F.lit("any"))).otherwise(F.array(F.lit("missing"), F.when(kind(F.col("w_artist")) == "cjk", "other").otherwise("cjk")))
    asked = w.withColumn("kind", F.explode(asks))
    if min_score > 1:  # titles that only begin alike give 1 at most here
        plain = asked.join(firsts, (F.col("w_title") == F.col("c_title")) & (asked.kind == firsts.kind)).select(cols)
    else:
        plain = _keyed(asked, "w_title", "short_w", "short_c").join(_keyed(firsts, "c_title", "short_c", "short_w"), ["key", "kind"]).select(cols)

    scored = met.unionByName(plain).withColumn("score", match_score(F.col("c_title"), F.col("c_artist"), F.col("w_title"), F.col("w_artist"))).where(F.col("score") >= min_score)
    best = scored.groupBy("w_title", "w_artist").agg(F.max_by(F.struct("cand_id", "score"), F.struct("score", (-F.col("pos")).alias("p"))).alias("b"))
    met = wanted.join(best, wanted.title.eqNullSafe(best.w_title) & wanted.artist.eqNullSafe(best.w_artist))
    return met.select("want_id", F.col("b.cand_id").alias("cand_id"), F.col("b.score").alias("score"))


def _words(artist: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(artist, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def _rarest_words(artists: DataFrame) -> DataFrame:
    """(artist, rarest): of the words of each artist the one that the fewest artists have."""
    words = artists.distinct().select("artist", F.explode(_words(F.col("artist"))).alias("word"))
    counted = words.join(words.groupBy("word").agg(F.count("*").alias("n")), "word")
    return counted.groupBy("artist").agg(F.min_by("word", F.struct("n", "word")).alias("rarest"))


def _named(rows: DataFrame, artist: str, rare: DataFrame, own: str, other: str) -> DataFrame:
    """Rows under the words that artists meet at: the rarest, as what may stand in the other, and all, as what holds it.

    An artist without letters or digits meets its equals, and those with as many other characters in a row.
    """
    name = F.col(artist)
    met = rows.join(rare.select(F.col("artist").alias(artist), "rarest"), artist, "left")
    key = lambda kind, word: F.concat(F.lit(f"{kind}:"), word)
    odd = F.when(name.rlike(rf"[^\p{{L}}\p{{N}}]{{{CONTAINED}}}"), F.array(F.lit(f"{other}:")))
    inside = F.when(F.col("rarest").isNull(), F.array(F.lit(f"{own}:"), key("same", name))).otherwise(F.array(key(own, F.col("rarest"))))
    words = F.concat(inside, F.transform(_words(name), lambda x: key(other, x)), F.coalesce(odd, F.array().cast("array<string>")))
    return met.withColumn("word", F.explode(F.array_distinct(words))).drop("rarest")


def _keyed(rows: DataFrame, title: str, own: str, other: str) -> DataFrame:
    """Rows under the keys that titles meet at: as long as both are, as the shorter side, and as the longer one."""
    t = F.col(title)
    size = F.least(F.length(t), F.lit(SHARED))
    key = lambda kind, n: F.concat(F.lit(f"{kind}:"), F.substring(t, F.lit(1), n))
    starts = F.when(size > CONTAINED, F.transform(F.sequence(F.lit(CONTAINED), size - 1), lambda n: key(other, n))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("key", F.explode(F.concat(F.array(key("same", size), key(own, size)), starts)))


def local_duplicates(rows: DataFrame, library: DataFrame) -> DataFrame:
    """Rows (lookup_key) with the first library pid of the same key, or null."""
    first = library.groupBy("lookup_key").agg(F.min_by("pid", "row_idx").alias("local_pid"))
    return rows.join(first, "lookup_key", "left")


def resolve_files(tracks: DataFrame, files: DataFrame, synthetic_prefix: str) -> DataFrame:
    """(pid, bucket, file_id, depth, n_files): matched, ambiguous, unmatched or without_location, one bucket per track.

    The file that shares most trailing path segments with the track's location wins if it is the only one. Segments are
    alike in any case and in any Unicode composition. Each side is known by all ends of its paths, and those of files are
    counted, so a file name that thousands share is one row, and a track's longest known end decides.
    """
    rows, found = _longest_ends(tracks, files, synthetic_prefix)
    bucket = F.when(~F.col("located"), "without_location").when(F.col("n_files").isNull(), "unmatched").when(F.col("n_files") > 1, "ambiguous").otherwise("matched")
    only = lambda c: F.when(F.col("n_files") == 1, F.col(c))
    return rows.join(found, "pid", "left").select("pid", bucket.alias("bucket"), only("file_id").alias("file_id"), only("depth").cast("long").alias("depth"), F.coalesce("n_files", F.lit(0)).alias("n_files"))


def ambiguous_files(tracks: DataFrame, files: DataFrame, synthetic_prefix: str) -> DataFrame:
    """(pid, file_id, depth): all files that share most segments with a track of the bucket ambiguous, and how many."""
    found = _longest_ends(tracks, files, synthetic_prefix)[1].where("n_files > 1")
    return found.select("pid", "end").join(_ends(files, "file_id"), "end").select("pid", "file_id", F.col("depth").cast("long").alias("depth"))


def _longest_ends(tracks: DataFrame, files: DataFrame, synthetic_prefix: str) -> tuple[DataFrame, DataFrame]:
    """(pid, located) of all tracks, and (pid, n_files, file_id, depth, end) of those that share an end with files: the longest."""
    rows = tracks.withColumn("path", decode_location(F.col("location")))
    located = F.coalesce(F.col("path").isNotNull() & (F.col("path") != "") & ~F.col("path").startswith(synthetic_prefix), F.lit(False))
    known = _ends(files, "file_id").groupBy("end").agg(F.count("*").alias("n_files"), F.min("file_id").alias("file_id"))
    met = _ends(rows.where(located), "pid").join(known, "end")
    found = met.groupBy("pid").agg(F.max_by(F.struct("n_files", "file_id", "depth", "end"), "depth").alias("f")).select("pid", "f.*")
    return rows.select("pid", located.alias("located")), found


def _ends(rows: DataFrame, key: str) -> DataFrame:
    """(key, depth, end): the last 1, 2, ... segments of a path, the last one first."""
    parts = rows.select(key, F.reverse(path_segments(_folded(F.col("path")))).alias("s"))
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size("s"), F.lit(1))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice("s", F.lit(1), n), "/").alias("end")))
    return parts.select(key, F.explode(ends).alias("e")).select(key, "e.*").where("end <> ''")


def _folded(path: Column) -> Column:
    """Lower case and composed; only text beyond ASCII leaves the JVM."""
    plain = path.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, F.lower(path)).otherwise(fold_segment(F.when(~plain, path)))
