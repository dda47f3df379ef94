"""Further registered queries: identities, summaries, trials and round trips through files, each with its statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonegrid.functions import text
from tonegrid.operators import analytics, enrich, features, geometry, library, linkage, placement, query, study
from tonegrid.operators.lineage import new_folder
from tonegrid.plans.bridge import points, view, with_views
from tonegrid.plans.queries import _C, _TOP, ORACLES, _r, _two_libraries, _whole, clustered, register, tracks_of
from tonegrid.sources import readers, sinks
from tonegrid.streaming import jobs



def state(name: str, sql: str) -> None:
    """Gives a query its statement, as it stands."""
    ORACLES[name] = sql


# --- identities ------------------------------------------------------------------------------------------------------


def _hash_sql(text: str) -> str:
    half = lambda seed, factor: f"lpad(format('{{:x}}', list_reduce(list_concat([{seed}::UBIGINT], list_transform(range(1, length({text}) + 1), lambda i: unicode({text}[i])::UBIGINT)), lambda acc, x: (xor(acc, x) * {factor}::UBIGINT) & 4294967295)), 8, '0')"
    return half(0x811C9DC5, 0x01000193) + " || " + half(0x01000193, 0x85EBCA6B)


@register("track_ids", f"SELECT row_idx, 'rb:' || {_hash_sql('basis')} AS pid, {_hash_sql('pid')} AS hash FROM (SELECT row_idx, pid, coalesce(artist, '') || '|' || name AS basis FROM tracks)", ("tracks",))
def track_ids(spark, sf):
    t = tracks_of(spark, sf)
    return t.select("row_idx", library.export_pid(F.lit(None).cast("string"), F.col("artist"), F.col("name"), F.col("row_idx")).alias("pid"), text.hash_64(F.col("pid")).alias("hash"))


@register("text_export_ids", f"""WITH b AS (SELECT p_partkey AS line, concat_ws(chr(9), p_brand, p_type, CAST(p_size AS STRING)) AS basis FROM part),
  n AS (SELECT *, row_number() OVER (PARTITION BY basis ORDER BY line) > 1 AS again FROM b), r AS (SELECT line, CASE WHEN again THEN basis || chr(9) || 'line:' || CAST(line AS STRING) ELSE basis END AS basis FROM n)
  SELECT line, 'rbtxt:' || {_hash_sql('basis')} AS pid FROM r""")  # fmt: skip
def text_export_ids(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").withColumn("line", F.col("p_partkey"))
    return library.text_export_pids(p, ["p_brand", "p_type", "p_size"]).select("line", "pid")


_NOTED = "CASE row_idx % 6 WHEN 0 THEN name || ' (Radio Edit)' WHEN 1 THEN name || ' - 2011 Remaster' WHEN 2 THEN name || ' feat. Someone Else' WHEN 3 THEN '\"' || name || '\"' WHEN 4 THEN name || ' [Extended Mix] (Live)' ELSE name END"
_CREDITED = "CASE row_idx % 4 WHEN 0 THEN artist || ' feat. Guest' WHEN 1 THEN artist || ' & Others' WHEN 2 THEN artist || ' vs. Them' ELSE artist END"


@register("normal_forms", "SELECT row_idx, lower(name) AS title, lower(artist) AS artist FROM tracks", ("tracks",))
def normal_forms(spark, sf):
    t = tracks_of(spark, sf).selectExpr("row_idx", f"{_NOTED} AS title", f"{_CREDITED} AS artist")
    return t.select("row_idx", text.normalize_title(F.col("title")).alias("title"), text.normalize_artist(F.col("artist")).alias("artist"))


_OWNER = "CASE row_idx % 5 WHEN 0 THEN '℗ 2011 ' || label || ', Ltd' WHEN 1 THEN '© 1999 ' || label || ' under exclusive licence to Others' WHEN 2 THEN 'DistroKid' WHEN 3 THEN label || '/Beatport' ELSE label END"


@register("copyright_labels", "SELECT row_idx, CASE WHEN row_idx % 5 = 2 THEN NULL ELSE label END AS label FROM tracks", ("tracks",))
def copyright_labels(spark, sf):
    t = tracks_of(spark, sf).selectExpr("row_idx", f"{_OWNER} AS line")
    return t.select("row_idx", text.label_of_copyright(F.col("line"), F.lit("nobody")).alias("label"))


# --- libraries -------------------------------------------------------------------------------------------------------


@register("playlist_items", """SELECT CAST(l_suppkey % 5 AS STRING) AS file, 'pl' || CAST(l_suppkey AS STRING) AS playlist, 'rb:' || CAST(l_partkey AS STRING) AS pid, l_orderkey * 8 + l_linenumber AS pos
  FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 4 <> 0)""")  # fmt: skip
def playlist_items(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("CAST(l_suppkey % 5 AS STRING) AS file", "'pl' || CAST(l_suppkey AS STRING) AS playlist", "l_partkey AS track_id", "l_orderkey * 8 + l_linenumber AS pos")
    t = tracks_of(spark, sf).where("row_idx % 4 <> 0").select(F.explode(F.array(*(F.lit(str(i)) for i in range(5)))).alias("file"), F.col("row_idx").alias("track_id"), "row_idx", "pid")
    return library.join_playlist_items(items, t)


@register("ensure_collections", "SELECT coalesce(nullif(collection, 'c1'), 'c0') AS collection, count(*) AS n, 'c0' AS known FROM tracks GROUP BY 1", ("tracks",))
def ensure_collections(spark, sf):
    t = tracks_of(spark, sf).withColumn("collection", F.nullif("collection", F.lit("c1")))
    metas = t.where("collection is not null").groupBy(F.col("collection").alias("id")).agg(F.count("*").alias("track_count")).select("id", F.col("id").alias("label"), F.substring("id", 2, 1).cast("int").alias("pos"), F.lit("rekordbox").alias("format"), "track_count")
    tagged, known = library.ensure_collections(t, metas)
    first = known.agg(F.min_by("id", "pos").alias("known"))
    return tagged.groupBy("collection").agg(F.count("*").alias("n")).crossJoin(F.broadcast(first))


@register("fallback_collection", "SELECT 'imported-library' AS id, 'Imported library' AS label, CAST(0 AS INTEGER) AS pos, 'rekordbox' AS format, count(*) AS track_count FROM tracks", ("tracks",))
def fallback_collection(spark, sf):
    t = tracks_of(spark, sf).withColumn("collection", F.lit(None).cast("string"))
    none = t.limit(0).select(F.col("collection").alias("id"), F.col("collection").alias("label"), F.lit(0).alias("pos"), F.col("collection").alias("format"), F.lit(0).cast("long").alias("track_count"))
    return library.ensure_collections(t, none)[1]


@register("downsample", """SELECT least(count(*), 100) AS n, least(count(*), 100) AS pids, CAST(0 AS BIGINT) AS strangers, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS torn FROM tracks""", ("tracks",))
def downsample(spark, sf):
    """A sample has the exact size, its memberships are all of its tracks', and what is emptied holds none."""
    t, m = tracks_of(spark, sf), view(spark, sf, "memberships")
    kept, narrowed, emptied = library.downsample_library(t, m, 100)
    kept = kept.select("pid")
    sizes = kept.agg(F.count("*").alias("n"), F.count_distinct("pid").alias("pids"))
    strangers = narrowed.join(kept, "pid", "left_anti").agg(F.count("*").alias("strangers"))
    lost = m.join(kept, "pid", "left_semi").join(narrowed, ["playlist", "pid"], "left_anti").agg(F.count("*").alias("lost"))
    torn = narrowed.join(emptied, "playlist", "left_semi").agg(F.count("*").alias("torn"))
    return sizes.crossJoin(F.broadcast(strangers)).crossJoin(F.broadcast(lost)).crossJoin(F.broadcast(torn))


@register("exclusion_report", "SELECT (SELECT count(DISTINCT pid) FROM trial) AS excluded, (SELECT count(DISTINCT pid) FROM trial WHERE pid NOT IN (SELECT pid FROM tracks)) AS unknown, count(*) AS eligible FROM tracks WHERE pid NOT IN (SELECT pid FROM trial)", ("tracks", "trial"))
def exclusion_report(spark, sf):
    return library.exclusion_report(tracks_of(spark, sf), view(spark, sf, "trial").select("pid"))


@register("sample_presets", "SELECT count(*) AS n, list_filter([500, 1000, 2000], lambda x: x < count(*)) AS presets FROM tracks", ("tracks",))
def sample_presets(spark, sf):
    return tracks_of(spark, sf).agg(F.count("*").alias("n")).select("n", library.sample_presets(F.col("n")).alias("presets"))


# --- answers and sound -----------------------------------------------------------------------------------------------

_FIRST = "SELECT pid, arg_min(raw_tempo, event_id) FILTER (raw_tempo IS NOT NULL) AS b, arg_min(open_key, event_id) FILTER (open_key IS NOT NULL) AS k, arg_min(via, event_id) FILTER (raw_tempo IS NOT NULL) AS bs FROM trial GROUP BY 1"
_DANCE = "regexp_matches(coalesce(genre, ''), '(?i)house|techno|trance|edm|dance|disco|electro|garage|hardstyle')"


@register("apply_answers", f"""WITH e AS ({_FIRST})
  SELECT t.pid, round(coalesce(bpm, b), 6) AS bpm, coalesce(key, k) AS key, CASE WHEN bpm IS NULL AND b IS NOT NULL THEN bs END AS source_bpm, CASE WHEN e.pid IS NOT NULL THEN ['own', 'seen'] ELSE ['own'] END AS tags,
  e.pid IS NOT NULL AS changed, coalesce(bpm IS NULL AND (b < 60 OR b > 200), false) AS bpm_suspect FROM tracks t LEFT JOIN e ON t.pid = e.pid""", ("tracks", "trial"))  # fmt: skip
def apply_answers(spark, sf):
    """Of many answers to one track, the first in order that states a field gives it."""
    a = view(spark, sf, "trial").select("pid", "event_id", F.col("raw_tempo").alias("bpm"), F.col("open_key").alias("key"), F.col("via").alias("source"), F.array(F.lit("seen")).alias("tags"))
    t = tracks_of(spark, sf).withColumn("tags", F.array(F.lit("own"))).withColumn("genre", F.lit("ballad"))
    return enrich.apply_answers(t, a, "event_id").select("pid", _r("bpm"), "key", "source_bpm", F.array_sort("tags").alias("tags"), "changed", "bpm_suspect")


@register("apply_audio", """WITH r AS (SELECT * FROM tracks WHERE row_idx % 2 = 0)
  SELECT t.pid, coalesce(t.bpm, CASE WHEN r.pid IS NOT NULL AND t.row_idx % 15 <> 0 THEN 80.0 END)::DOUBLE AS bpm, coalesce(t.key, CASE WHEN r.pid IS NOT NULL THEN '3B' END) AS key,
  CASE WHEN r.pid IS NOT NULL AND t.row_idx % 3 <> 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS timbre,
  t.bpm IS NULL AND r.pid IS NOT NULL AND t.row_idx % 15 <> 0 AS bpm_suspect,
  r.pid IS NOT NULL AND ((t.bpm IS NULL AND t.row_idx % 15 <> 0) OR t.key IS NULL OR t.row_idx % 3 <> 0) AS changed FROM tracks t LEFT JOIN r ON t.pid = r.pid""", ("tracks",))  # fmt: skip
def apply_audio(spark, sf):
    """Half the tracks have results, some without timbre, some manual; a slow tempo of a dance genre is suspect."""
    t = tracks_of(spark, sf).withColumn("timbre", F.array(F.lit(1.0))).withColumn("genre", F.lit("Techno")).withColumn("source_bpm", F.when(F.col("row_idx") % 15 == 0, "manual"))
    r = t.where("row_idx % 2 = 0").select("pid", F.lit(80.0).alias("bpm"), F.lit("3B").alias("key"), F.lit(False).alias("ambiguous"), F.when(F.col("row_idx") % 3 != 0, F.array(F.lit(2.0))).alias("timbre"))
    return enrich.apply_audio(t, r).select("pid", "bpm", "key", F.get("timbre", F.lit(0)).alias("timbre"), "bpm_suspect", "changed")


# --- summaries -------------------------------------------------------------------------------------------------------


@register("taste_report", f"""WITH g AS ({_TOP.format(c='genre')}), a AS ({_TOP.format(c='artist')}),
  tag AS (SELECT 'tag' AS kind, CAST(row_number() OVER (ORDER BY n DESC, seen, pos, term) AS INTEGER) AS rank, term, CAST(n AS DOUBLE) AS value FROM (SELECT term, count(*) AS n, min(row_idx) AS seen, arg_min(pos, row_idx * 2 + pos) AS pos
    FROM (SELECT row_idx, 0 AS pos, genre AS term FROM tracks UNION ALL SELECT row_idx, 1, label FROM tracks WHERE label IS NOT NULL) GROUP BY term) QUALIFY rank <= 20)
  SELECT * FROM g UNION ALL SELECT * FROM a UNION ALL SELECT * FROM tag UNION ALL SELECT 'top10_artist_share', 0, '', round(sum(value) / (SELECT count(*) FROM tracks), 6) FROM a WHERE rank <= 10""", ("tracks",))  # fmt: skip
def taste_report(spark, sf):
    return analytics.taste_report(tracks_of(spark, sf).withColumn("tags", F.array_compact(F.array("genre", "label"))))


_BINS = """q AS (SELECT quantile_cont(bpm, 0.05) AS lo, quantile_cont(bpm, 0.95) AS hi FROM tracks WHERE bpm > 0),
  w AS (SELECT *, CASE WHEN (hi - lo) / 10 <= 1 THEN 1.0 WHEN (hi - lo) / 10 <= 2 THEN 2.0 WHEN (hi - lo) / 10 <= 2.5 THEN 2.5 WHEN (hi - lo) / 10 <= 5 THEN 5.0 ELSE 10.0 END AS width FROM q),
  sc AS (SELECT *, floor(lo / width) * width AS start, greatest(1, floor((ceil(hi / width) * width - floor(lo / width) * width) / width + 0.5)) AS cnt FROM w)"""
_BIN = "CAST(greatest(0, least(cnt - 1, floor((bpm - start) / width))) AS INTEGER)"


@register("legends", f"""WITH {_BINS} SELECT 'genre' AS mode, lower(genre) AS slot, count(*) AS n FROM tracks GROUP BY ALL UNION ALL SELECT 'collection', collection, count(*) FROM tracks GROUP BY ALL
  UNION ALL SELECT 'key', key, count(*) FROM tracks GROUP BY ALL UNION ALL SELECT 'year', CAST(CAST(floor(year / 10.0) * 10 AS INTEGER) AS STRING), count(*) FROM tracks GROUP BY ALL
  UNION ALL SELECT 'cluster', CAST(row_idx % 10 AS STRING), count(*) FROM tracks GROUP BY ALL UNION ALL SELECT 'bpm', CASE WHEN bpm > 0 THEN CAST({_BIN} AS STRING) END, count(*) FROM tracks, sc GROUP BY ALL""", ("tracks",))  # fmt: skip
def legends(spark, sf):
    t, out = clustered(spark, sf), None
    scale = analytics.tempo_scale(t)
    for mode in ("genre", "collection", "key", "year", "cluster", "bpm"):
        part = analytics.legend(t, mode, scale).select(F.lit(mode).alias("mode"), "slot", "n")
        out = part if out is None else out.unionByName(part)
    return out


@register("highlight_facets", f"""WITH {_BINS} SELECT 'bpm' AS kind, pid FROM tracks, sc WHERE bpm IS NOT NULL AND {_BIN} = 3 UNION ALL SELECT 'key', pid FROM tracks WHERE key = '8A'
  UNION ALL SELECT 'cluster', pid FROM tracks WHERE row_idx % 10 = 4 UNION ALL SELECT 'genre', pid FROM tracks WHERE lower(genre) = (SELECT min(lower(genre)) FROM tracks)""", ("tracks",))  # fmt: skip
def highlight_facets(spark, sf):
    t, out = clustered(spark, sf), None
    scale = analytics.tempo_scale(t)
    genre = t.agg(F.min(F.lower("genre"))).first()[0]
    for kind, value in (("bpm", 3), ("key", "8A"), ("cluster", 4), ("genre", genre)):
        part = query.highlighted(t, kind, value, scale=scale).select(F.lit(kind).alias("kind"), "pid")
        out = part if out is None else out.unionByName(part)
    return out


@register("influence_notes", """WITH n AS (SELECT count(*) AS total, count(label) AS label, count(*) FILTER (pid IN (SELECT pid FROM memberships)) AS filed FROM tracks), p AS (SELECT count(DISTINCT playlist) AS lists FROM memberships)
  SELECT 'sound' AS kind, false AS enabled, 0::BIGINT AS n, total, NULL::BIGINT AS playlists FROM n
  UNION ALL SELECT 'label', true, label, total, NULL FROM n UNION ALL SELECT 'playlist', true, filed, total, lists FROM n, p""", ("tracks", "memberships"))  # fmt: skip
def influence_notes(spark, sf):
    return analytics.influence_notes(tracks_of(spark, sf), view(spark, sf, "memberships"))


@register("outstanding_note", """WITH c AS (SELECT collection AS id, count(*) AS total, count(*) FILTER (collection <> 'c1' AND (bpm IS NULL OR key IS NULL)) AS incomplete FROM tracks GROUP BY 1),
  n AS (SELECT 'Missing BPM or key: ' || string_agg(id || ' (' || format('{:,}', incomplete) || ' of ' || format('{:,}', total) || ')', ', ' ORDER BY id) FILTER (incomplete > 0) || '. Skipping ' || string_agg(id, ', ' ORDER BY id) FILTER (incomplete = 0) || ', already complete.' AS note FROM c)
  SELECT id AS collection, incomplete, total, incomplete = 0 AS complete, note FROM c, n""", ("tracks",))  # fmt: skip
def outstanding_note(spark, sf):
    """All tracks; the second collection has what it lacks filled in, so that one is complete."""
    t = tracks_of(spark, sf)
    filled = {c: F.when(F.col("collection") == "c1", F.coalesce(c, F.lit(v))).otherwise(F.col(c)) for c, v in (("bpm", 120.0), ("key", "8A"))}
    return analytics.outstanding_note(analytics.coverage(t.withColumns(filled)))


_FIVE = "SELECT cluster, string_agg(term, ',' ORDER BY n DESC, seen, term) AS {c}s FROM (SELECT cluster, {c} AS term, count(*) AS n, min(row_idx) AS seen FROM {t} WHERE {c} IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, seen, term) <= 5) GROUP BY 1"
_LABELS = f"""{_C}, term AS (SELECT cluster, row_idx, genre AS term FROM c WHERE genre IS NOT NULL UNION ALL SELECT cluster, row_idx, artist FROM c WHERE artist IS NOT NULL),
  tf AS (SELECT cluster, term, count(*) AS tf, min(row_idx) AS seen FROM term GROUP BY ALL), df AS (SELECT term, sum(tf) AS df FROM tf GROUP BY 1), size AS (SELECT cluster, count(*) AS size FROM c GROUP BY 1),
  sc AS (SELECT tf.cluster, tf.term, seen, round(tf / size * ln((SELECT count(*) FROM c) / df), 9) AS score FROM tf JOIN df ON tf.term = df.term JOIN size ON size.cluster = tf.cluster),
  rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, seen, term) AS r FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY cluster, lower(term) ORDER BY score DESC, seen, term) = 1)),
  two AS (SELECT cluster, string_agg(term, ' / ' ORDER BY r) AS label, string_agg(lower(term), ' / ' ORDER BY lower(term)) AS same FROM rk WHERE r <= 2 GROUP BY 1),
  pl AS (SELECT *, count(*) OVER (PARTITION BY same) AS many FROM two),
  own AS (SELECT rk.cluster, rk.term, r, count(*) OVER (PARTITION BY same, lower(term)) AS holders FROM rk JOIN pl ON pl.cluster = rk.cluster WHERE many > 1),
  lone AS (SELECT cluster, arg_min(term, r) AS own FROM own WHERE holders = 1 AND r > 2 GROUP BY 1),
  nm AS (SELECT pl.cluster, CASE WHEN many > 1 THEN label || ' · ' || coalesce(own, 'Cluster ' || CAST(pl.cluster + 1 AS STRING)) ELSE label END AS label FROM pl LEFT JOIN lone ON lone.cluster = pl.cluster),
  lab AS (SELECT nm.cluster, size, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY nm.cluster) > 1 THEN label || ' · Cluster ' || CAST(nm.cluster + 1 AS STRING) ELSE label END AS label FROM nm JOIN size ON size.cluster = nm.cluster)"""


@register("cluster_labels", f"WITH {_LABELS} SELECT cluster, size, label FROM lab", ("tracks",))
def cluster_labels(spark, sf):
    return analytics.cluster_labels(clustered(spark, sf))


@register("summarize_clusters", f"""WITH {_LABELS}, m AS (SELECT c.cluster, playlist, row_idx FROM memberships JOIN c ON c.pid = memberships.pid), g AS ({_FIVE.format(c='genre', t='c')}), a AS ({_FIVE.format(c='artist', t='c')}), p AS ({_FIVE.format(c='playlist', t='m')})
  SELECT lab.cluster, size, label, genres, artists, playlists FROM lab JOIN g ON g.cluster = lab.cluster JOIN a ON a.cluster = lab.cluster JOIN p ON p.cluster = lab.cluster""", ("tracks", "memberships"))  # fmt: skip
def summarize_clusters(spark, sf):
    found = analytics.summarize_clusters(clustered(spark, sf), view(spark, sf, "memberships"))
    return found.select("cluster", "size", "label", *(F.array_join(c, ",").alias(c) for c in ("genres", "artists", "playlists")))


@register("suggest_queries", f"""WITH {_C}, g AS (SELECT cluster, list(genre ORDER BY r) AS g FROM (SELECT cluster, genre, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, min(row_idx)) AS r FROM c WHERE genre IS NOT NULL GROUP BY cluster, genre) WHERE r <= 3 GROUP BY 1),
  a AS (SELECT cluster, artist AS a FROM (SELECT cluster, artist, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, min(row_idx)) AS r FROM c WHERE artist IS NOT NULL GROUP BY cluster, artist) WHERE r = 1),
  y AS (SELECT cluster, CAST(floor(list_sort(list(year))[CAST(floor(count(*) / 2) AS INTEGER) + 1] / 10.0) * 10 AS INTEGER) AS d FROM c GROUP BY 1),
  n AS (SELECT g.cluster, g, a, d FROM g JOIN a ON a.cluster = g.cluster JOIN y ON y.cluster = g.cluster),
  p AS (SELECT x.cluster, x.g[1] AS g1, x.g[2] AS g12, z.g[1] AS g2, z.g[2] AS g22, x.a AS aa, z.a AS ab, CAST(CAST(floor((x.d + z.d) / 20.0 + 0.5) * 10 AS INTEGER) AS STRING) AS era FROM n x JOIN n z ON z.cluster = x.cluster + 1),
  t AS (SELECT cluster, CASE WHEN lower(g1) <> lower(g2) THEN [g1 || ' ' || g2, g2 || ' ' || g1, era || 's ' || g1 || ' ' || g2, g1 || ' ' || g22, g12 || ' ' || g2] ELSE [g1 || ' ' || g12, g1 || ' deep cuts'] END || [CASE WHEN aa <> ab THEN 'artists like ' || aa || ' and ' || ab ELSE 'artists like ' || aa END] AS q FROM p)
  SELECT cluster, list_filter(list_filter(q, lambda x: x IS NOT NULL), lambda x, i: list_position(list_transform(list_filter(q, lambda v: v IS NOT NULL), lambda w: lower(w)), lower(x)) = i)[1:5] AS queries FROM t""", ("tracks",))  # fmt: skip
def suggest_queries(spark, sf):
    n = analytics.neighborhoods(clustered(spark, sf))
    b = n.select((F.col("cluster") - 1).alias("cluster"), F.col("genres").alias("g2"), F.col("artists").alias("a2"), F.col("decade").alias("d2"))
    c = F.col
    return n.join(b, "cluster").select("cluster", analytics.suggest_queries(c("genres"), c("artists"), c("decade"), c("g2"), c("a2"), c("d2")).alias("queries"))


# --- studies ---------------------------------------------------------------------------------------------------------


@register("mixed_clusters", """WITH c AS (SELECT *, row_idx % 7 AS cluster FROM tracks WHERE row_idx % 7 <> 2 OR collection <> 'c1' OR row_idx % 5 = 0), n AS (SELECT cluster, collection, count(*) AS n FROM c GROUP BY ALL),
  mix AS (SELECT cluster, sum(n) AS size FROM n GROUP BY 1 HAVING min(n) / sum(n) > 0.1 AND count(*) > 1), r AS (SELECT c.* FROM c JOIN mix ON mix.cluster = c.cluster),
  g AS (SELECT cluster, string_agg(genre || ' (' || CAST(n AS STRING) || ')', ',' ORDER BY n DESC, seen) AS genres FROM (SELECT cluster, genre, count(*) AS n, min(row_idx) AS seen FROM r WHERE genre IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, seen) <= 4) GROUP BY 1),
  e AS (SELECT cluster, string_agg(e, ',' ORDER BY e) AS examples FROM (SELECT cluster, arg_min(collection || ': ' || coalesce(artist, '?') || ' — ' || name, row_idx) AS e FROM r GROUP BY cluster, collection) GROUP BY 1),
  b AS (SELECT cluster, list_sort(list(bpm))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median_bpm FROM r WHERE bpm > 0 GROUP BY 1)
  SELECT mix.cluster, CAST(size AS BIGINT) AS size, median_bpm, genres, examples FROM mix JOIN g ON g.cluster = mix.cluster JOIN e ON e.cluster = mix.cluster JOIN b ON b.cluster = mix.cluster""", ("tracks",))  # fmt: skip
def mixed_clusters(spark, sf):
    t = tracks_of(spark, sf).withColumn("cluster", F.col("row_idx") % 7).where("row_idx % 7 <> 2 OR collection <> 'c1' OR row_idx % 5 = 0")
    return study.mixed_clusters(t).select("cluster", "size", "median_bpm", F.array_join("genres", ",").alias("genres"), F.array_join("examples", ",").alias("examples"))


@register("size_matched", "WITH n AS (SELECT collection, count(*) AS n FROM tracks WHERE row_idx % 5 <> 0 OR collection <> 'c2' GROUP BY 1) SELECT collection, (SELECT min(n) FROM n) AS n, (SELECT min(n) FROM n) AS pids FROM n", ("tracks",))
def size_matched(spark, sf):
    t = tracks_of(spark, sf).where("row_idx % 5 <> 0 OR collection <> 'c2'")
    return study.size_matched(t).groupBy("collection").agg(F.count("*").alias("n"), F.count_distinct("pid").alias("pids"))


_GATE = """CASE WHEN nth > 1 THEN 'duplicate' WHEN known IS NULL THEN 'unknown' WHEN status <> 'matched' THEN 'unmatched:' || status WHEN via <> 'combined' THEN 'title-only'
  WHEN event_id % 5 = 0 OR (artist IS NOT NULL AND event_id % 11 <> 0 AND event_id % 7 = 0) THEN 'refused' WHEN raw_tempo <= 0 THEN 'no-tempo'
  WHEN (open_key IS NULL OR open_key = '13m') AND (key_of IS NULL OR key_of = 'H-dur') THEN 'no-key' ELSE 'kept' END"""
_GATED = f"n AS (SELECT trial.*, tracks.pid AS known, row_number() OVER (PARTITION BY trial.pid ORDER BY event_id) AS nth FROM trial LEFT JOIN tracks ON tracks.pid = trial.pid), g AS (SELECT *, {_GATE} AS gate FROM n)"


@register("trial_funnel", f"WITH {_GATED} SELECT gate, count(*) AS n FROM g GROUP BY 1", ("tracks", "trial"))
def trial_funnel(spark, sf):
    return study.trial_funnel(view(spark, sf, "trial"), tracks_of(spark, sf))


@register("refused_examples", f"""WITH {_GATED} SELECT event_id, '"' || title || '" ' || coalesce(artist, '?') || ' → ' || coalesce(matched_artist, '?') AS example FROM g WHERE gate = 'refused' ORDER BY event_id LIMIT 12""", ("tracks", "trial"))
def refused_examples(spark, sf):
    return study.refused_examples(view(spark, sf, "trial"), tracks_of(spark, sf))


@register("hit_rates", """WITH h AS (SELECT *, CASE open_key WHEN '1m' THEN '8A' WHEN '2m' THEN '9A' END AS ok, CASE key_of WHEN 'Am' THEN '8A' END AS ko, status = 'matched' AS hit, via = 'combined' AS strict FROM trial),
  q AS (SELECT list_sort(list(raw_tempo)) AS l, count(*) AS c FROM h WHERE hit AND raw_tempo > 0)
  SELECT count(*) AS n, count(*) FILTER (hit) AS matched, count(*) FILTER (hit AND strict) AS strict, count(*) FILTER (hit AND NOT strict) AS fallback, round(count(*) FILTER (hit) / count(*) * 100, 6) AS matched_pct, round(count(*) FILTER (hit AND strict) / count(*) * 100, 6) AS strict_pct,
  count(*) FILTER (hit AND raw_tempo > 0) AS tempo, count(*) FILTER (hit AND coalesce(ok, ko) IS NOT NULL) AS key, count(*) FILTER (hit AND strict AND raw_tempo > 0) AS strict_tempo, count(*) FILTER (hit AND strict AND coalesce(ok, ko) IS NOT NULL) AS strict_key,
  count(*) FILTER (hit AND strict AND raw_tempo > 0 AND coalesce(ok, ko) IS NOT NULL) AS strict_both, count(*) FILTER (hit AND event_id % 11 = 0 AND event_id % 10 <> 0 AND event_id % 5 <> 0) AS suspect, count(*) FILTER (hit AND ok <> ko) AS disagree, count(*) FILTER (hit AND ok IS NULL AND ko IS NOT NULL) AS key_of_only,
  (SELECT l[1] FROM q) AS low, (SELECT l[CAST(floor((c - 1) * 0.25) AS INTEGER) + 1] FROM q) AS p25, (SELECT l[CAST(floor((c - 1) * 0.5) AS INTEGER) + 1] FROM q) AS median, (SELECT l[CAST(floor((c - 1) * 0.75) AS INTEGER) + 1] FROM q) AS p75, (SELECT l[c] FROM q) AS high FROM h""", ("trial",))  # fmt: skip
def hit_rates(spark, sf):
    return study.hit_rates(view(spark, sf, "trial"))


@register("failing_spellings", "SELECT field, spelling, count(*) AS n FROM (SELECT status, 'key_of' AS field, key_of AS spelling FROM trial UNION ALL SELECT status, 'open_key', open_key FROM trial) WHERE status = 'matched' AND spelling IN ('H-dur', '13m') GROUP BY ALL", ("trial",))
def failing_spellings(spark, sf):
    return study.failing_spellings(view(spark, sf, "trial"))


@register("trial_cost", "SELECT round(5000 / n, 6) AS per_track, CAST(2000 AS BIGINT) AS per_hour, CAST(round(5000 / n * t) AS BIGINT) AS all_requests, CAST(round(150.0 / n * t) AS BIGINT) AS all_minutes FROM (SELECT count(*) AS n FROM trial), (SELECT count(*) AS t FROM tracks)", ("tracks", "trial"))
def trial_cost(spark, sf):
    return study.trial_cost(view(spark, sf, "trial"), tracks_of(spark, sf), 5000, 9_000_000)


# --- sources and sinks -----------------------------------------------------------------------------------------------


@register("catalogue_answers", """SELECT row_idx, row_idx % 3 AS shop, CAST(0 AS INTEGER) AS pos, CAST(row_idx AS STRING) AS catalogue_id, artist, name AS title, CASE WHEN row_idx % 3 = 1 THEN genre END AS album, CASE WHEN row_idx % 3 <> 2 THEN bpm END AS bpm,
  CASE WHEN row_idx % 3 = 0 THEN key END AS key, CASE WHEN row_idx % 3 = 1 AND year > 1900 THEN year END AS year, CASE WHEN row_idx % 3 = 1 THEN CAST(duration_ms // 1000 AS BIGINT) * 1000 END AS duration_ms,
  CASE WHEN row_idx % 3 <> 0 THEN 'http://p/' || CAST(row_idx AS STRING) END AS preview_url, CASE WHEN row_idx % 3 = 2 THEN [genre] END AS tags FROM tracks WHERE row_idx % 7 <> 0""", ("tracks",))  # fmt: skip
def catalogue_answers(spark, sf):
    """Answers in the shapes of three catalogues, and errors."""
    t = tracks_of(spark, sf)
    c, named = F.col, F.struct(F.col("artist").alias("name"))
    preview = F.concat(F.lit("http://p/"), c("row_idx").cast("string"))
    tempo = F.to_json(F.struct(F.array(F.struct(c("row_idx").alias("id"), named.alias("artist"), c("name").alias("title"), F.coalesce(c("bpm").cast("string"), F.lit("0")).alias("tempo"), c("key").alias("open_key"), F.lit("?").alias("key_of"))).alias("search")))
    record = F.to_json(F.struct(F.array(F.struct(c("row_idx").alias("id"), c("name").alias("title"), named.alias("artist"), F.struct(c("genre").alias("title")).alias("album"), F.coalesce(c("bpm"), F.lit(0.0)).alias("bpm"), preview.alias("preview"), F.floor(c("duration_ms") / 1000).alias("duration"), F.concat(c("year").cast("string"), F.lit("-01-01")).alias("release_date"))).alias("data")))
    song = F.to_json(F.struct(F.lit(1).alias("resultCount"), F.array(F.struct(c("row_idx").alias("id"), c("name").alias("trackName"), c("artist").alias("artistName"), preview.alias("previewUrl"), c("genre").alias("primaryGenreName"))).alias("results")))
    shop = F.col("row_idx") % 3
    body = F.when(c("row_idx") % 7 == 0, '{"search": {"error": "no result"}}').when(shop == 0, tempo).when(shop == 1, record).otherwise(song)
    return readers.parse_candidates(t.select("row_idx", shop.alias("shop"), body.alias("body"))).drop("copyright")


_ENCODED = "replace(pid, ':', '%3A')"


@register("xml_track_lines", f"""SELECT row_idx, '<TRACK TrackID="' || CAST(row_idx AS STRING) || '" Name="' || name || '"' || coalesce(' Artist="' || artist || '"', '') || ' Genre="' || genre || '" TotalTime="' || format('{{:.3f}}', duration_ms / 1000) || '" Year="' || CAST(year AS STRING) || '"' ||
  coalesce(' AverageBpm="' || format('{{:.2f}}', bpm) || '"', '') || coalesce(' Tonality="' || key || '"', '') || coalesce(' Label="' || label || '"', '') || ' Location="file://localhost{sinks.SYNTHETIC}' || {_ENCODED} || '"/>' AS line FROM tracks""", ("tracks",))  # fmt: skip
def xml_track_lines(spark, sf):
    return sinks.xml_track_lines(tracks_of(spark, sf))


def _xml(spark, sf) -> str:
    out = new_folder(spark, "exports")
    t = tracks_of(spark, sf).withColumn("name", F.concat("name", F.lit(' & "<more>"'))).withColumn("date_added", F.lit("2024-05-06T07:08"))
    sinks.write_xml(t, view(spark, sf, "memberships"), out)
    return out


@register("xml_tracks_read_back", f"""SELECT row_idx AS track_id, name || ' & "<more>"' AS name, artist, genre, year, CAST(duration_ms AS BIGINT) AS duration_ms, bpm, key, CASE WHEN artist IS NULL THEN label END AS label, CASE WHEN bpm IS NOT NULL THEN 1.0 END::DOUBLE AS bpm_confidence, CASE WHEN key IS NOT NULL THEN 'rekordbox' END AS source_key, '{sinks.SYNTHETIC}' || pid AS path, DATE '2024-05-06' AS date_added, 'file://localhost{sinks.SYNTHETIC}' || {_ENCODED} AS location FROM tracks""", ("tracks",))
def xml_tracks_read_back(spark, sf):
    """The whole library written as one XML document and read again; a label that is the artist's own name is none."""
    return readers.read_xml_tracks(spark, f"{_xml(spark, sf)}/*.txt").select("track_id", "name", "artist", "genre", "year", "duration_ms", "bpm", "key", "label", "bpm_confidence", "source_key", "path", "date_added", "location")


@register("xml_playlists_read_back", "SELECT playlist, CAST(0 AS INTEGER) AS key_type, CAST(row_idx AS STRING) AS key, row_number() OVER (PARTITION BY playlist ORDER BY row_idx) - 1 AS pos FROM memberships m JOIN tracks t ON m.pid = t.pid", ("tracks", "memberships"))
def xml_playlists_read_back(spark, sf):
    return readers.read_xml_playlists(spark, f"{_xml(spark, sf)}/*.txt").select("playlist", "key_type", "key", "pos")


@register("text_export_read_back", "SELECT name, artist AS by, bpm AS tempo, key AS camelot, CAST(duration_ms // 1000 AS BIGINT) * 1000 AS duration_ms, CAST(DATE '2020-01-01' + CAST(row_idx % 300 AS INTEGER) AS DATE) AS added FROM tracks", ("tracks",))
def text_export_read_back(spark, sf):
    """The library written as a tab-separated export and read again."""
    c, out = F.col, new_folder(spark, "exports")
    seconds = F.floor(c("duration_ms") / 1000)
    clock = F.format_string("%02d:%02d", F.floor(seconds / 60), seconds % 60)
    rows = tracks_of(spark, sf).select(
        c("row_idx").alias("#"), F.lit("").alias("Artwork"), c("name").alias("Track Title"), c("artist").alias("Artist"), F.lit("").alias("Album"), c("genre").alias("Genre"), c("bpm").alias("BPM"), F.lit("").alias("Rating"),
        clock.alias("Time"), c("key").alias("Key"), F.date_add(F.lit("2020-01-01").cast("date"), (c("row_idx") % 300).cast("int")).cast("string").alias("Date Added"),
    )
    sinks.write_text_export(rows, out)
    return readers.read_text_export(spark, f"{out}/*.csv", "UTF-8").select("name", "by", "tempo", "camelot", "duration_ms", "added")


@register("text_export_report", "SELECT count(*) AS declared, count(*) FILTER (row_idx % 9 <> 0) AS parsed, count(*) FILTER (row_idx % 9 = 0) AS skipped FROM tracks", ("tracks",))
def text_export_report(spark, sf):
    out = new_folder(spark, "exports")
    rows = tracks_of(spark, sf).select(*(F.when(F.col("row_idx") % 9 != 0, F.col("name")).alias(c) if c == "Track Title" else F.lit("-").alias(c) for c in readers.TEXT_COLUMNS))
    sinks.write_text_export(rows, out)
    return readers.text_export_report(spark, f"{out}/*.csv", "UTF-8")


@register("library_read_back", "SELECT pid, name, collection FROM tracks WHERE collection = 'c2'", ("tracks",))
def library_read_back(spark, sf):
    out = new_folder(spark, "exports")
    sinks.save_library(tracks_of(spark, sf).select("pid", "name", "collection", F.col("collection").alias("library_id")), out)
    return sinks.load_library(spark, out, "c2")


@register("map_header", "SELECT 'two' AS scenario, 42 AS seed, 15 AS knn, count(DISTINCT cluster) AS clusters, count(*) AS points, (SELECT string_agg(c || '=' || CAST(n AS STRING), ',' ORDER BY c) FROM (SELECT collection AS c, count(*) AS n FROM points GROUP BY 1)) AS collections FROM points", ("points",))
def map_header(spark, sf):
    from tonegrid.plans.bridge import points

    one = sinks.map_header(points(spark, sf), "two", 42, 15)
    return one.withColumn("collections", F.array_join(F.transform("collections", lambda x: F.concat(x["id"], F.lit("="), x["trackCount"].cast("string"))), ","))


# --- features --------------------------------------------------------------------------------------------------------


@register("timbre_features", """WITH v AS (SELECT p_partkey AS row_idx, CASE WHEN p_partkey % 3 <> 0 THEN [CAST(p_size AS DOUBLE), p_retailprice / 100, CAST(p_partkey % 17 AS DOUBLE)] END AS t FROM part),
  d AS (SELECT row_idx, i, t[i] AS x FROM v, range(1, 4) r(i) WHERE t IS NOT NULL), m AS (SELECT i, avg(x) AS mean, stddev_pop(x) AS std FROM d GROUP BY 1),
  z AS (SELECT row_idx, d.i, (x - mean) / std AS z FROM d JOIN m ON m.i = d.i)
  SELECT row_idx, count(*) AS n, round(sqrt(sum(z * z)) / (SELECT sqrt(sum(z * z) / count(DISTINCT row_idx)) FROM z) * 2, 4) AS norm FROM z WHERE z <> 0 GROUP BY 1""")  # fmt: skip
def timbre_features(spark, sf):
    """Sound features of two thirds of the tracks, scaled over the rows that have them."""
    timbre = F.when(F.col("row_idx") % 3 != 0, F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100, (F.col("row_idx") % 17).cast("double")))
    t = tracks_of(spark, sf).join(spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("row_idx"), "p_size", "p_retailprice"), "row_idx").withColumn("timbre", timbre)
    rows, _ = features.fit_features(t, view(spark, sf, "memberships").limit(0), features.Options(timbre=1.0))
    return rows.where("block = 'timbre'").groupBy("row_idx").agg(F.count("*").alias("n"), F.round(F.sqrt(F.sum(F.col("value") * F.col("value"))), 4).alias("norm"))


# --- statements of queries on vectors and features -------------------------------------------------------------------

_EVERY = ORACLES["fit_features"][: ORACLES["fit_features"].rindex("SELECT every.block")]
state("encode_tracks", f"{_EVERY} SELECT row_idx, count(*) AS n, round(sum(value * f), 6) AS total FROM every JOIN s ON s.block = every.block WHERE value <> 0 AND every.block IN ('label', 'numeric') GROUP BY 1")
state("ablation", f"""{_EVERY}, used AS (SELECT every.block, value * f AS value FROM every JOIN s ON s.block = every.block WHERE value <> 0 AND every.block <> 'artist')
  SELECT without, count(*) AS n, round(sum(value * value), 6) AS energy FROM used, (VALUES ('nothing'), ('genre'), ('label')) w(without) WHERE block <> without GROUP BY 1""")


def _strengths(pairs: str, rho: str) -> str:
    """Neighbours n (q, row_idx, d, r) with strength w and share, their bandwidths found by halving."""
    return f"""near AS (SELECT * FROM ({pairs}) WHERE r <= 15), lists AS (SELECT q, list(d ORDER BY r) AS ds FROM near GROUP BY 1),
      start AS (SELECT q, ds, {rho} AS rho FROM lists),
      step AS (SELECT q, ds, rho, 0 AS i, 0.0::DOUBLE AS lo, NULL::DOUBLE AS hi, 1.0::DOUBLE AS mid, true AS going FROM start UNION ALL
        SELECT q, ds, rho, i + 1, CASE WHEN still AND total <= log2(15) THEN mid ELSE lo END, CASE WHEN still AND total > log2(15) THEN mid ELSE hi END,
          CASE WHEN NOT still THEN mid WHEN total > log2(15) THEN (lo + mid) / 2 WHEN hi IS NULL THEN mid * 2 ELSE (mid + hi) / 2 END, still
        FROM (SELECT *, going AND abs(total - log2(15)) >= 1e-5 AS still FROM (SELECT *, list_sum(list_transform(ds[2:], lambda x: exp(-greatest(x - rho, 0) / mid))) AS total FROM step WHERE i < 64))),
      sigma AS (SELECT q, rho, greatest(mid, 1e-3 * list_avg(ds)) AS sigma FROM step WHERE i = 64),
      n AS (SELECT near.*, CASE WHEN d <= rho THEN 1.0 ELSE exp(-greatest(d - rho, 0) / sigma) END AS w FROM near JOIN sigma ON sigma.q = near.q),
      shared AS (SELECT *, w / sum(w) OVER (PARTITION BY q) AS share FROM n)"""


_VECTOR_PAIRS = "SELECT a.vec_id AS q, b.vec_id AS row_idx, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id"
_PLACED = f"WITH RECURSIVE {with_views('points')[5:]}, {_strengths(_VECTOR_PAIRS + ' AND a.vec_id % 50 = 0', '0.0::DOUBLE')}"
state("place_vectors", f"{_PLACED} SELECT q AS query, round(sum(share * x), 6) AS x, round(sum(share * y), 6) AS y FROM shared JOIN points p ON p.row_idx = shared.row_idx GROUP BY 1")
state("transfer_labels", f"""{_PLACED}, v AS (SELECT q, cluster, round(sum(share), 12) AS w, min(r) AS first FROM shared JOIN points p ON p.row_idx = shared.row_idx GROUP BY 1, 2)
  SELECT q AS query, cluster FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY w DESC, first) = 1""")
state("fuzzy_graph", f"""WITH RECURSIVE {_strengths(_VECTOR_PAIRS, 'list_filter(ds, lambda x: x > 0)[1]')}
  SELECT least(q, row_idx) AS a, greatest(q, row_idx) AS b, round(sum(w) - CASE WHEN count(*) > 1 THEN product(w) ELSE 0 END, 6) AS weight FROM n WHERE w > 0 GROUP BY 1, 2""")
_TEMPO_KEY = """t AS (SELECT row_idx, bpm, year, [log2(bpm), sin(2 * pi() * (log2(bpm) % 1)), cos(2 * pi() * (log2(bpm) % 1)), sin((num - 1) * (2 * pi() / 12)), cos((num - 1) * (2 * pi() / 12)), CASE WHEN right(key, 1) = 'A' THEN 1.0 ELSE 0.0 END]::DOUBLE[] AS v
  FROM (SELECT *, CAST(regexp_extract(key, '^(\\d+)', 1) AS INTEGER) AS num FROM tracks WHERE bpm IS NOT NULL AND key IS NOT NULL))"""
_TRACK_PAIRS = "SELECT a.row_idx AS q, b.row_idx AS row_idx, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.row_idx ORDER BY list_distance(a.v, b.v), b.row_idx) AS r FROM t a, t b WHERE a.row_idx <> b.row_idx"
state("place_by_tempo_key", f"WITH RECURSIVE {with_views('tracks')[5:]}, {_TEMPO_KEY}, {_strengths(_TRACK_PAIRS, '0.0::DOUBLE')} SELECT q AS query, round(sum(share * bpm), 6) AS x, round(sum(share * year), 6) AS y FROM shared JOIN t ON t.row_idx = shared.row_idx GROUP BY 1")
state("hulls", f"""WITH RECURSIVE {with_views('points')[5:]}, p AS (SELECT DISTINCT cluster, x, y FROM points),
  edge AS (SELECT a.cluster, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON a.cluster = b.cluster AND (a.x <> b.x OR a.y <> b.y) JOIN p c ON c.cluster = a.cluster
    GROUP BY ALL HAVING bool_and((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) >= 0)),
  walk AS (SELECT cluster, CAST(0 AS BIGINT) AS pos, first(x ORDER BY x, y) AS x, first(y ORDER BY x, y) AS y, first(x ORDER BY x, y) AS sx, first(y ORDER BY x, y) AS sy FROM p GROUP BY 1 UNION ALL
    SELECT w.cluster, pos + 1, bx, by_, sx, sy FROM walk w JOIN edge e ON e.cluster = w.cluster AND e.ax = w.x AND e.ay = w.y WHERE bx <> sx OR by_ <> sy)
  SELECT cluster, pos, round(x, 6) AS x, round(y, 6) AS y FROM walk""")


# --- places ----------------------------------------------------------------------------------------------------------


@register("lasso_table", """WITH b AS (SELECT cluster, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points GROUP BY 1),
  g AS (SELECT 'c' || CAST(cluster AS STRING) AS polygon_id, [{'x': x0, 'y': y0 / 2}, {'x': x1, 'y': y0}, {'x': x1 / 4, 'y': 0.0}, {'x': x1 / 2, 'y': y1}] AS corners FROM b
    UNION ALL SELECT 'p' || CAST(row_idx AS STRING), [{'x': x - 0.02, 'y': y - 0.015}, {'x': x + 0.03, 'y': y}, {'x': x, 'y': y + 0.025}] FROM points WHERE row_idx % 50 = 0),
  e AS (SELECT polygon_id, corners[i] AS a, corners[i % len(corners) + 1] AS b FROM (SELECT polygon_id, corners, unnest(range(1, len(corners) + 1)) AS i FROM g))
  SELECT polygon_id, row_idx FROM e, points p WHERE (a.y > p.y) <> (b.y > p.y) AND p.x < (b.x - a.x) * (p.y - a.y) / (b.y - a.y) + a.x GROUP BY ALL HAVING count(*) % 2 = 1""", ("points",))  # fmt: skip
def lasso_table(spark, sf):
    """A polygon for each cluster, as large as it, and a small one around every 50th point."""
    p = points(spark, sf)
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y = F.col("x"), F.col("y")
    b = p.groupBy("cluster").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    x0, x1, y0, y1 = map(F.col, ("x0", "x1", "y0", "y1"))
    large = b.select(F.concat(F.lit("c"), F.col("cluster").cast("string")).alias("polygon_id"), F.array(corner(x0, y0 / 2), corner(x1, y0), corner(x1 / 4, F.lit(0.0)), corner(x1 / 2, y1)).alias("corners"))
    small = p.where("row_idx % 50 = 0").select(F.concat(F.lit("p"), F.col("row_idx").cast("string")).alias("polygon_id"), F.array(corner(x - 0.02, y - 0.015), corner(x + 0.03, y), corner(x, y + 0.025)).alias("corners"))
    return query.in_polygons(p, large.unionByName(small))


@register("ambiguous_files", """WITH f AS (SELECT page_id AS file_id, list_reverse(list_filter(string_split(lower(regexp_replace(url, '[0-9]+$', '')), '/'), lambda x: x <> '')) AS b FROM pages),
  d AS (SELECT a.file_id AS pid, f.file_id, list_min(list_filter(range(1, len(a.b) + 2), lambda i: a.b[i] IS DISTINCT FROM f.b[i] OR i > len(a.b))) - 1 AS depth FROM f a JOIN f ON a.b[1] = f.b[1])
  SELECT pid, file_id, depth FROM (SELECT *, rank() OVER (PARTITION BY pid ORDER BY depth DESC) AS r FROM d) WHERE r = 1 QUALIFY count(*) OVER (PARTITION BY pid) > 1""")  # fmt: skip
def ambiguous_files(spark, sf):
    """Pages by their urls without numbers at the end, which many share."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.regexp_replace("url", "[0-9]+$", "").alias("path"))
    return linkage.ambiguous_files(pages.select(F.col("page_id").alias("pid"), F.col("path").alias("location")), pages.select(F.col("page_id").alias("file_id"), "path"), sinks.SYNTHETIC)


# --- outside and edited tracks ---------------------------------------------------------------------------------------


def _map_points(spark, sf):
    return points(spark, sf).selectExpr("'p' || CAST(row_idx AS STRING) AS pid", "row_idx", "x", "y", "CAST(cluster AS INT) AS cluster")


_MAP = "m AS (SELECT 'p' || CAST(row_idx AS STRING) AS pid, row_idx, x, y, CAST(cluster AS INTEGER) AS cluster FROM points)"


@register("attach_points", f"WITH {_MAP} SELECT * FROM m WHERE row_idx % 3 <> 0 UNION ALL SELECT pid, row_idx, x + 1 AS x, y, cluster FROM m WHERE row_idx % 2 = 0 AND row_idx % 3 = 0", ("points",))
def attach_points(spark, sf):
    m = _map_points(spark, sf)
    return placement.attach_outside(m.where("row_idx % 3 <> 0"), m.where("row_idx % 2 = 0").withColumn("x", F.col("x") + 1))


@register("reproject_points", f"WITH {_MAP} SELECT pid, row_idx, CASE WHEN row_idx % 4 = 0 THEN y ELSE x END AS x, CASE WHEN row_idx % 4 = 0 THEN x ELSE y END AS y, CASE WHEN row_idx % 4 = 0 THEN 99 ELSE cluster END AS cluster FROM m", ("points",))
def reproject_points(spark, sf):
    """Every fourth point at its mirrored place; pids that no point has add nothing."""
    m = _map_points(spark, sf)
    new = m.where("row_idx % 4 = 0").selectExpr("pid", "y AS x", "x AS y", "99 AS cluster")
    return geometry.reproject(m, new.unionByName(new.withColumn("pid", F.concat(F.lit("no "), "pid"))))


@register("move_edited")
def move_edited(spark, sf):
    """The map by tempo and key, on which tracks whose row is a multiple of 40 were edited by hand."""
    t = tracks_of(spark, sf).withColumns({"source_bpm": F.when(F.col("row_idx") % 40 == 0, "manual"), "source_key": F.lit(None).cast("string")})
    known = t.where("bpm is not null or key is not null").select("pid", "row_idx", F.col("duration_ms").cast("double").alias("x"), F.col("year").cast("double").alias("y"), F.expr("CAST(row_idx % 5 AS INT) AS cluster"))
    return placement.move_edited(t, known).select("pid", _r("x"), _r("y"), "cluster")


# --- streams ---------------------------------------------------------------------------------------------------------


@register("streamed_library", ORACLES["merge_whole_library"])
def streamed_library(spark, sf):
    """A library that is there, and one that arrives twice as a file."""
    base, new = _two_libraries(spark, sf, "row_idx % 2 = 0")
    new = new._replace(memberships=new.memberships.distinct())
    folder = new_folder(spark, "streams")
    jobs.start_library(base, f"{folder}/store")
    for _ in range(2):
        jobs.import_rows(new, "C3").repartition(1).write.mode("append").parquet(f"{folder}/in")
    jobs.stream_library(spark, f"{folder}/in", new.tracks._jdf.schema().toDDL(), f"{folder}/store").awaitTermination()
    return _whole(jobs.read_library(spark, f"{folder}/store"))


_ASKED = "CASE event_id % 3 WHEN 0 THEN 'bpm' WHEN 1 THEN 'key' ELSE 'label' END"


@register("lookup_queue", f"""WITH e AS (SELECT pid, ts, status, {_ASKED} AS f FROM outcomes), last AS (SELECT max(ts) AS now FROM e),
  n AS (SELECT pid, unnest(list_filter([CASE WHEN bpm IS NULL THEN 'bpm' END, CASE WHEN key IS NULL THEN 'key' END, CASE WHEN label IS NULL THEN 'label' END], lambda x: x IS NOT NULL)) AS f FROM tracks)
  SELECT pid, f AS field FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.pid = n.pid AND e.f = n.f AND (e.status = 'purchase' OR (e.status = 'click' AND e.ts > (SELECT now FROM last) - INTERVAL 7 DAY)))""", ("tracks", "outcomes"))  # fmt: skip
def lookup_queue(spark, sf):
    """Purchases stand for hits, clicks for misses, the rest for errors; the queue as of the last event."""
    none = F.lit(None).cast("array<string>")
    need = F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in ("bpm", "key", "label"))))
    wanted = tracks_of(spark, sf).select("pid", F.lit("2000-01-01").cast("timestamp").alias("ts"), need.alias("need"), F.lit(None).cast("string").alias("status"), none.alias("covered"), none.alias("have"))
    status = F.when(F.col("status") == "purchase", "hit").when(F.col("status") == "click", "miss").otherwise("error")
    asked = view(spark, sf, "outcomes").withColumns({"ts": F.col("ts").cast("timestamp"), "covered": F.array(F.expr(_ASKED)), "status": status, "need": none, "have": none})
    folder = new_folder(spark, "streams")
    for part in (asked.where("event_id % 2 = 0"), wanted, asked.where("event_id % 2 = 1")):
        part.select("pid", "ts", "need", "status", "covered", "have").write.mode("append").parquet(f"{folder}/in")
    jobs.stream_lookups(spark, f"{folder}/in", f"{folder}/table", f"{folder}/check", parts=8).awaitTermination()
    now = asked.agg(F.max("ts")).first()[0]
    left = enrich.outstanding_lookups(jobs.read_table(spark, f"{folder}/table"), F.lit(now).cast("timestamp"))
    return left.select("pid", F.explode("outstanding").alias("field"))
