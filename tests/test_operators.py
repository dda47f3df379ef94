"""Operators on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.operators import analytics, audio, enrich, features, geometry, library, lineage, linkage, query, sets
from tonegrid.sources import readers, sinks

TRACK = "pid string, row_idx long, bpm double, key string, confidence double"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_suggestions_respect_every_branch(spark):
    t = spark.createDataFrame([("a", 0, 120.0, "8A", 1.0), ("b", 1, 124.0, "8B", 1.0), ("c", 2, 124.0, "2A", 1.0), ("d", 3, None, "9A", 1.0), ("e", 4, 60.0, None, 1.0), ("f", 5, None, None, 1.0), ("g", 6, 150.0, "8A", 1.0)], TRACK)
    out = sets.suggest_next(t, t.where("pid = 'a'"), 10)
    assert [(r.to_pid, r.score) for r in out.orderBy("rank").collect()] == [("b", 1.0), ("d", 0.6), ("e", 0.6)]
    alone = sets.suggest_next(t, t.where("pid = 'f'"), 10)
    assert alone.count() == 6 - 0 and {r.score for r in alone.collect()} == {0.36}


@pytest.mark.parametrize("n, tempo, k", [(60, lambda r: float(r.integers(60, 200)), 5), (160, lambda r: round(float(r.uniform(60, 200)), 2), 3), (120, lambda r: round(float(128 * 2.0 ** r.integers(-2, 3) * r.uniform(0.93, 1.07)), 2), 200)])
def test_suggestions_agree_with_all_pairs(spark, n, tempo, k):
    rng = np.random.default_rng(n)
    data = [(f"p{i}", i, None if rng.random() < 0.2 else tempo(rng), None if rng.random() < 0.2 else f"{rng.integers(1, 13)}{'AB'[rng.integers(2)]}", [0.5, 1.0, 0.8, None][rng.integers(4)]) for i in range(n)]
    t = spark.createDataFrame(data, TRACK)
    side = lambda p: F.struct("pid", "row_idx", "bpm", "key", F.col("confidence").alias("bpm_conf"), F.col("confidence").alias("key_conf")).alias(p)
    pairs = t.select(side("a")).crossJoin(t.where("bpm is not null or key is not null").select(side("b"))).where("a.pid <> b.pid")
    j = sets.transition("a", "b")
    want = pairs.select(F.col("a.pid").alias("p"), F.col("b.pid").alias("q"), F.col("b.row_idx").alias("i"), j["score"].alias("s"), j["compat"].alias("c"), j["delta_pct"].alias("d")).where("coalesce(c, '') <> 'clash' and coalesce(d, 0) <= 6").collect()
    best = {}
    for r in sorted(want, key=lambda r: (-r.s, r.i)):
        best.setdefault(r.p, []).append((r.q, r.s))
    got = {}
    for r in sets.suggest_next(t, k=k).orderBy("pid", "rank").collect():
        got.setdefault(r.pid, []).append((r.to_pid, r.score))
    assert got == {p: v[:k] for p, v in best.items()}


def test_tempo_cells_hold_what_the_tolerance_says():
    """Within INNER any two tempos pass, beyond OUTER none does."""
    passes = lambda ratio: math.floor(abs(ratio - 1) * 1000 + 0.5) / 10 <= 6
    for d in range(-16, 17):
        ends = [2 ** ((d + e) / sets.CELLS) for e in (-0.999999, -0.5, 0, 0.5, 0.999999)]
        assert all(map(passes, ends)) if sets.INNER[0] <= d <= sets.INNER[1] else d in sets.OUTER or not any(map(passes, ends))


def test_redundant_imports_change_nothing_and_others_bring_all(spark):
    make = lambda tracks, members, collections: library.Library(spark.createDataFrame(tracks, "pid string, row_idx long, collection string"), spark.createDataFrame(members, "playlist string, pid string"), spark.createDataFrame(collections, "id string, label string, pos int, track_count long"))
    base = make([("x", 0, "a"), ("y", 1, "a")], [("set", "x")], [("a", "First", 0, 2)])
    again = library.merge(base, make([("x", 0, "b")], [("set", "x"), ("other", "x")], [("b", "Second", 0, 1)]), "Second")
    assert again is base
    more = library.merge(base, make([("x", 0, "b"), ("z", 1, "b")], [("set", "x"), ("other", "z")], [("b", "Second", 0, 9), ("c", "Empty", 1, 4)]), "Second")
    assert rows(more.tracks.select("pid", "collection"), "pid") == [("x", "a"), ("y", "a"), ("z", "b")]
    assert rows(more.memberships, "playlist", "pid") == [("other", "z"), ("set", "x"), ("set [Second]", "x")]
    assert rows(more.collections.select("id", "pos", "track_count"), "pos") == [("a", 0, 2), ("b", 1, 1), ("c", 2, 4)]
    empty = make([], [], [])
    assert library.merge(empty, base, "First").tracks.count() == 2 and library.merge(base, empty, "x") is base


def test_overrides_leave_the_rest_alone(spark):
    t = spark.createDataFrame(
        [("a", 120.0, "8A", "deezer", "file", 0.5, 0.4, True), ("b", 90.0, None, "deezer", None, 0.5, None, True), ("c", 100.0, "1A", None, "file", None, 0.3, False), ("d", 1.0, "2A", "x", "y", 0.1, 0.2, True)],
        "pid string, bpm double, key string, source_bpm string, source_key string, confidence_bpm double, confidence_key double, bpm_suspect boolean",
    )
    o = spark.createDataFrame([("a", 126.0, None, 1), ("a", 125.0, None, 2), ("b", None, "3B", 1), ("b", 0.0, "", 2), ("none", 1.0, "1A", 1)], "pid string, bpm double, key string, ts int")
    assert rows(library.apply_overrides(t, o), "pid") == [
        ("a", 125.0, "8A", "manual", "file", 1.0, 0.4, False), ("b", 90.0, "3B", "deezer", "manual", 0.5, 1.0, True), ("c", 100.0, "1A", None, "file", None, 0.3, False), ("d", 1.0, "2A", "x", "y", 0.1, 0.2, True),
    ]
    bare = library.apply_overrides(t.select("pid", "bpm", "key"), o).where("pid = 'a'").first()
    assert (bare.bpm, bare.source_bpm, bare.confidence_bpm, bare.source_key) == (125.0, "manual", 1.0, None)


def test_memberships_are_dealt_in_tasks_of_bounded_rows(spark):
    """Repeats within a side and between sides count once, and the number of tasks follows the number of rows."""
    m = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "playlist string, pid string")
    n = spark.createDataFrame([("a", "z"), ("a", "z"), ("c", "y")], "playlist string, pid string")
    merged = library.merge_memberships(m, n, library.rename_clashing(n, m, "new"), 5 * lineage.TASK_ROWS)
    assert rows(merged, "playlist", "pid") == [("a", "x"), ("a [new]", "z"), ("b", "y"), ("c", "y")]
    assert merged.rdd.getNumPartitions() == 5


def test_merged_libraries_deal_memberships_by_their_rows(spark):
    t = lambda *pids: spark.createDataFrame([(p, i, "c") for i, p in enumerate(pids)], "pid string, row_idx long, collection string")
    m = lambda *pairs: spark.createDataFrame(list(pairs), "playlist string, pid string")
    listed = spark.createDataFrame([("c", "C", 0, 1)], "id string, label string, pos int, track_count long")
    base, more = library.Library(t("x"), m(("a", "x"), ("a", "x")), listed), library.Library(t("x", "y"), m(("a", "y"), ("a", "y"), ("b", "x")), listed)
    n = 6 * lineage.TASK_ROWS
    members = library.merge(base, more, "new", n).memberships
    assert rows(members, "playlist", "pid") == [("a", "x"), ("a [new]", "y"), ("b", "x")]
    assert members.rdd.getNumPartitions() % 6 == 0


def test_merge_keeps_the_first_and_inherits_playlists(spark):
    a = spark.createDataFrame([("x", 0, "old")], "pid string, row_idx long, name string")
    b = spark.createDataFrame([("x", 0, "new"), ("y", 1, "y")], "pid string, row_idx long, name string")
    assert rows(library.merge_tracks(a, b), "pid") == [("x", 0, "old"), ("y", 1, "y")]
    assert tuple(library.merge_report(a, b).first()) == (1, 1, False)
    m, n = (spark.createDataFrame([(p, q)], "playlist string, pid string") for p, q in (("set", "x"), ("set", "y")))
    names = library.rename_clashing(n, m, "new")
    assert rows(library.merge_memberships(m, n, names), "playlist") == [("set", "x"), ("set [new]", "y")]
    taken = m.unionByName(spark.createDataFrame([("set [new]", "z")], "playlist string, pid string"))
    assert rows(library.rename_clashing(n, taken, "new"), "playlist") == [("set", "set [new 2]")]


def test_ids_are_numbered_from_the_first_gap(spark):
    w, t = (spark.createDataFrame([(x,) for x in ids], "id string") for ids in (["a", "b", "c-2"], ["a", "a-2", "a-4", "c-2"]))
    assert {tuple(r) for r in library.unique_ids(w, t).collect()} == {("a", "a-3"), ("b", "b"), ("c-2", "c-2-2")}


def test_sample_is_exact_and_repeats(spark):
    t = spark.range(500).select(F.concat(F.lit("p"), "id").alias("pid"))
    a, b = (sorted(r.pid for r in library.sample(t, 50, 7).collect()) for _ in range(2))
    assert len(set(a)) == 50 and a == b
    assert library.sample(t, 1000).count() == 500


def test_playlist_filter(spark):
    p = spark.createDataFrame([("f", "Library", 0, None, None), ("f", "one", 1, None, None), ("f", "copy", 2, None, None), ("f", "empty", 3, None, None), ("f", "all", 4, True, None)], "file string, playlist string, pos long, master boolean, distinguished long")
    i = spark.createDataFrame([("f", n, t) for n in ("Library", "one", "copy", "all") for t in (1, 2)], "file string, playlist string, track_id long")
    kept, dropped = library.filter_playlists(p, i)
    assert [r.playlist for r in kept.collect()] == ["one"]
    assert dropped.count() == 4


def test_gap_between_two_blobs(spark):
    rng = np.random.default_rng(0)
    pts = [(i, float(x + c * 10), float(y), c) for c in (0, 1) for i, (x, y) in enumerate(rng.normal(0, 0.5, (50, 2)))]
    p = spark.createDataFrame(pts, "row_idx long, x double, y double, cluster int")
    gap = analytics.find_gaps(p).collect()
    assert len(gap) == 1 and 3 < gap[0].x < 7 and gap[0].isolation > 0.6


def test_labels_of_clusters_are_distinct(spark):
    t = spark.createDataFrame([(i, i % 3, "House", f"A{i % 3}" if i % 3 else None) for i in range(30)] + [(99, 5, None, None)], "row_idx long, cluster long, genre string, artist string")
    labels = {r.cluster: r.label for r in analytics.cluster_labels(t).collect()}
    assert len(set(labels.values())) == 4 and labels[5] == "Cluster 6"


def test_tempo_scale(spark):
    t = spark.createDataFrame([(float(b),) for b in range(60, 201)], "bpm double")
    s = analytics.tempo_scale(t)
    assert (s.width, s.start, s.count <= 14) == (10, 60, True) or s.width in (10, 20)
    assert analytics.tempo_scale(t.limit(0)).count == 14


def test_matching(spark):
    w = spark.createDataFrame([(1, "blue monday", "new order"), (2, "abc", "米津玄師"), (3, "lonely song", "eli")], "want_id long, title string, artist string")
    c = spark.createDataFrame([(10, 0, "blue monday", "the new order"), (11, 1, "blue monday", "new order"), (12, 2, "abc", "kenshi"), (13, 3, "lonely song", "feliciano")], "cand_id long, pos long, title string, artist string")
    assert rows(linkage.match_candidates(w, c), "want_id") == [(1, 11, 4), (2, 12, 3)]


@pytest.mark.parametrize("least", [1, 2, 3])
def test_matching_against_all_pairs(spark, least):
    """Titles that begin alike, artists within artists, missing ones, scripts, punctuation, repeats and ties."""
    rng = np.random.default_rng(least)
    titles = ["intro", "intro", "intro", "introduction", "introduction to it all", "intr", "int", "intermission one", "intermission two", "夜に駆ける", None, ""]
    artists = [None, "", "band", "the band", "dj band", "dj", "dj the", "Ünder", "ünder world", "米津玄師", "米津 x", "!!!", "!!!!", "what!!!! now", "a-ha", "ha", "aha", "x band x", "bandage", "new order", "the new order", "order new"]
    make = lambda n: [(i, titles[rng.integers(len(titles))], artists[rng.integers(len(artists))]) for i in range(n)]
    w, c = make(90), make(120)
    w_frame = spark.createDataFrame(w, "want_id long, title string, artist string")
    c_frame = spark.createDataFrame([(1000 + i, 119 - i, t, a) for i, t, a in c], "cand_id long, pos long, title string, artist string")
    pairs = w_frame.selectExpr("want_id", "title AS wt", "artist AS wa").crossJoin(c_frame.selectExpr("cand_id", "pos", "title AS ct", "artist AS ca"))
    best = {}
    for r in pairs.withColumn("score", linkage.match_score(*(F.col(x) for x in ("ct", "ca", "wt", "wa")))).where(F.col("score") >= least).collect():
        best[r.want_id] = max(best.get(r.want_id, (-1, 0, 0)), (r.score, -r.pos, r.cand_id))
    assert rows(linkage.match_candidates(w_frame, c_frame, least), "want_id") == [(i, b[2], b[0]) for i, b in sorted(best.items())]
    assert len(best) > 30


def test_a_hot_title_makes_no_square(spark):
    """Of 300 tracks named alike on both sides, no row before the score holds more than a few for each."""
    w = spark.createDataFrame([(i, "intro", f"group {i} of the town") for i in range(300)], "want_id long, title string, artist string")
    c = spark.createDataFrame([(i, i, "intro", f"group {i} of the town") for i in range(300)], "cand_id long, pos long, title string, artist string")
    rare = linkage._rarest_words(w.select("artist"))
    a = linkage._named(linkage._keyed(w, "title", "short_w", "short_c"), "artist", rare, "in_c", "in_w")
    b = linkage._named(linkage._keyed(c, "title", "short_c", "short_w"), "artist", rare, "in_w", "in_c")
    assert a.join(b, ["key", "word"]).count() <= 300 * 4
    assert rows(linkage.match_candidates(w, c), "want_id") == [(i, i, 4) for i in range(300)]


@pytest.mark.parametrize(("hay", "needle", "there"), [("the new order", "new order", True), ("feliciano", "elic", False), ("abab ab", "ab", True), ("xneux neu", "neu", True)])
def test_whole_words(spark, hay, needle, there):
    assert spark.range(1).select(linkage.contains_word(F.lit(hay), F.lit(needle))).first()[0] is there


def test_every_track_is_in_one_bucket(spark):
    t = spark.createDataFrame([("a", "file://localhost/m/x/1.mp3"), ("b", "/q/2.mp3"), ("c", None), ("d", "/no/9.mp3"), ("e", "/no-local-file/e")], "pid string, location string")
    f = spark.createDataFrame([(1, "x/1.mp3"), (2, "y/1.mp3"), (3, "k/2.MP3"), (4, "l/2.mp3")], "file_id long, path string")
    got = {r.pid: (r.bucket, r.file_id, r.depth) for r in linkage.resolve_files(t, f, "/no-local-file/").collect()}
    assert got == {"a": ("matched", 1, 2), "b": ("ambiguous", None, None), "c": ("without_location", None, None), "d": ("unmatched", None, None), "e": ("without_location", None, None)}


def test_cascade_routes_by_need(spark):
    w = spark.createDataFrame([("k", ["bpm", "label"], None), ("m", ["bpm"], ["bpm"])], "lookup_key string, need array<string>, covered array<string>")
    a = spark.createDataFrame([("k", "hit", 120.0), ("m", "hit", 99.0)], "lookup_key string, status string, bpm double")
    b = spark.createDataFrame([("k", "error", "L")], "lookup_key string, status string, label string")
    out = {r.lookup_key: r for r in enrich.cascade(w, [enrich.Tier("one", ("bpm",), a), enrich.Tier("two", ("label",), b)]).collect()}
    assert (out["k"].bpm, out["k"].label, out["k"].status_two, out["k"].covered_now) == (120.0, None, "error", ["bpm"])
    assert (out["m"].bpm, out["m"].status_one) == (None, None)


def test_polygon_edges(spark):
    p = spark.createDataFrame([(0.5, 0.5), (2.0, 2.0)], "x double, y double")
    square = [(0, 0), (1, 0), (1, 1), (0, 1)]
    assert p.where(query.in_polygon(F.col("x"), F.col("y"), square)).count() == 1
    assert p.where(query.in_polygon(F.col("x"), F.col("y"), square[:2])).count() == 0


def test_encoding_repeats_the_fit_outside_playlists(spark):
    t = spark.createDataFrame([(i, f"p{i}", 100.0 + i, f"{i % 12 + 1}A", 2000 + i, 200_000 + i, f"g{i % 3}", f"L{i % 2}", f"a{i % 4}") for i in range(12)], "row_idx long, pid string, bpm double, key string, year int, duration_ms long, genre string, label string, artist string")
    m = spark.createDataFrame([("pl", f"p{i}") for i in range(5)], "playlist string, pid string")
    fitted, encoder = features.fit_features(t, m, features.Options(artist=0.5))
    again = features.encode(t, encoder)
    key = lambda f: {(r.row_idx, r.block, r.term): round(r.value, 9) for r in f.where("block <> 'playlist'").collect()}
    assert key(fitted) == key(again)
    energy = {r[0]: r[1] for r in fitted.groupBy("block").agg(F.sum(F.col("value") ** 2)).collect()}
    assert energy["numeric"] / 12 == pytest.approx(1.0) and energy["genre"] / 12 == pytest.approx(0.25)
    assert len(features.vectors(fitted, encoder, t).first().vec) == features.columns(encoder).count()


def test_label_weight_zero_leaves_no_label(spark):
    t = spark.createDataFrame([(i, f"p{i}", "L", "g") for i in range(4)], "row_idx long, pid string, label string, genre string").selectExpr("*", "120D + row_idx AS bpm", "'8A' AS key", "2000 AS year", "1000L AS duration_ms", "'a' AS artist")
    fitted, encoder = features.fit_features(t, t.select(F.lit("pl").alias("playlist"), "pid"), features.Options(label=0.75, semantic=0.0))
    assert encoder.scales.get("label", 1.0) == 1.0
    assert fitted.where("block = 'genre'").count() == 0


def test_neighbours_agree_with_brute_force(spark):
    x = np.round(np.random.default_rng(3).normal(size=(80, 5)), 1)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_idx long, vec array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = {i: sorted(range(80), key=lambda j: (d[i, j], j))[:4] for i in range(80)}
    got = {}
    for r in geometry.nearest(v, k=4, block_rows=30).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r.row_idx)
    assert got == want


@pytest.mark.parametrize("target", [None, "kind"])
def test_neighbours_in_cells_of_blobs_and_copies(spark, target):
    rng = np.random.default_rng(8)
    x = np.round(np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in ((0, 0, 0), (9, 0, 0), (0, 9, 9), (50, 50, 0))] + [np.ones((60, 3))]), 2)
    v = spark.createDataFrame([(i, r.tolist(), i % 3) for i, r in enumerate(x)], "row_idx long, vec array<double>, kind int").repartition(3)
    q = spark.createDataFrame([(1000 + i, r, i % 3) for i, r in enumerate([[0.1, 0.0, 0.0], [200.0, 1.0, 1.0], [1.0, 1.0, 1.0], [math.nan, 0.0, 0.0]])], "row_idx long, vec array<double>, kind int")
    for queries, asked in ((None, [(i, r, i % 3) for i, r in enumerate(x)]), (q, [(r.row_idx, np.array(r.vec), r.kind) for r in q.collect()[:3]])):
        got = {}
        for r in geometry.nearest(v, queries, k=5, target=target, block_rows=16).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append(r.row_idx)
        fits = lambda i, c, j: j % 3 != c if target else i != j
        assert got == {i: sorted((j for j in range(len(x)) if fits(i, c, j)), key=lambda j: (np.sqrt(((r - x[j]) ** 2).sum()), j))[:5] for i, r, c in asked}


@pytest.mark.parametrize("target", [None, "kind"])
def test_neighbours_in_cells_that_are_split_again(spark, target):
    rng = np.random.default_rng(9)
    x = np.round(np.concatenate([rng.normal(c, 1.0, (n, 3)) for c, n in (((0, 0, 0), 260), ((30, 0, 0), 5), ((0, 40, 0), 120))] + [np.ones((40, 3))]), 2)
    v = spark.createDataFrame([(i, r.tolist(), i % 3) for i, r in enumerate(x)], "row_idx long, vec array<double>, kind int").repartition(3)
    far = [[500.0, 1.0, 1.0], [0.0, 38.0, 0.5], [1.0, 1.0, 1.0]]
    q = spark.createDataFrame([(1000 + i, r, i % 3) for i, r in enumerate(far)], "row_idx long, vec array<double>, kind int")
    for queries, asked in ((None, [(i, r, i % 3) for i, r in enumerate(x)]), (q, [(1000 + i, np.array(r), i % 3) for i, r in enumerate(far)])):
        got = {}
        for r in geometry.nearest(v, queries, k=5, target=target, block_rows=16, cells=3).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append(r.row_idx)
        fits = lambda i, c, j: j % 3 != c if target else i != j
        assert got == {i: sorted((j for j in range(len(x)) if fits(i, c, j)), key=lambda j: (np.sqrt(((r - x[j]) ** 2).sum()), j))[:5] for i, r, c in asked}


@pytest.mark.parametrize("target", [None, "kind"])
def test_neighbours_of_many_equal_rows_are_the_lowest(spark, target):
    rng = np.random.default_rng(4)
    kinds = np.round(rng.normal(size=(3, 6)), 3)
    ids = rng.permutation(300).tolist()
    x = {i: kinds[n % 3] for n, i in enumerate(ids)}
    v = spark.createDataFrame([(i, x[i].tolist(), i % 2) for i in ids], "row_idx long, vec array<double>, kind int").coalesce(1)
    got = {}
    for r in geometry.nearest(v, k=4, target=target).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r.row_idx)
    fits = lambda i, j: i % 2 != j % 2 if target else i != j
    assert got == {i: sorted((j for j in x if fits(i, j)), key=lambda j: (np.sqrt(((x[i] - x[j]) ** 2).sum()), j))[:4] for i in x}


def test_reduction_keeps_distances(spark):
    x = np.random.default_rng(5).normal(size=(40, 3)) @ np.random.default_rng(6).normal(size=(3, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_idx long, vec array<double>")
    y, basis = geometry.reduce_dims(v, 3)
    z = np.array([r.vec for r in y.orderBy("row_idx").collect()])
    assert np.allclose(((z[:, None] - z[None]) ** 2).sum(-1), ((x[:, None] - x[None]) ** 2).sum(-1)) and basis.shape == (8, 3)
    assert geometry.reduce_dims(v, 8)[1] is None


def test_kmeans_finds_blobs_and_repeats(spark):
    rng = np.random.default_rng(0)
    p = spark.createDataFrame([(i, float(8 * (i % 3) + a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 0.3, (60, 2)))], "row_idx long, x double, y double")
    a = {r.row_idx: r.cluster for r in geometry.kmeans_2d(p, 3)[0].collect()}
    assert len({(i % 3, c) for i, c in a.items()}) == 3
    assert a == {r.row_idx: r.cluster for r in geometry.kmeans_2d(p, 3)[0].collect()}


def _held(monkeypatch, found) -> list[int]:
    """How many rows of queries go into each comparison while ``found`` runs."""
    seen, real = [], geometry._compared
    monkeypatch.setattr(geometry, "_compared", lambda asked, *rest: seen.append(asked.count()) or real(asked, *rest))
    found()
    return seen


def test_a_query_goes_to_a_shelf_once(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (600, 12))  # no shape: most cells are within reach
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_idx long, vec array<double>")
    got = {}

    def found():
        for r in geometry.nearest(v, k=3, block_rows=30).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append(r["row_idx"])

    seen = _held(monkeypatch, found)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert got == {i: np.argsort(d[i], kind="stable")[:3].tolist() for i in range(600)}
    assert max(seen) <= 600 * 10  # 80 cells of 30 rows or less, shelves of 120


def test_neighbours_read_twice_are_the_same(spark):
    x = np.random.default_rng(0).normal(0, 1, (600, 4))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_idx long, vec array<double>")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    want = {i: np.argsort(d[i], kind="stable")[:3].tolist() for i in range(600)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        near = geometry.nearest(v, k=3, block_rows=50)
        rows = near.withColumn("side", F.lit(0)).unionByName(near.withColumn("side", F.lit(1))).orderBy("query", "rank").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for side in (0, 1):
        got = {}
        for r in rows:
            if r["side"] == side:
                got.setdefault(r["query"], []).append(r["row_idx"])
        assert got == want


def test_equal_queries_ask_once(spark, monkeypatch):
    v = spark.range(9000).selectExpr("id AS row_idx", "array(CAST(id % 7 AS DOUBLE), CAST(id % 3 AS DOUBLE)) AS vec", "id % 2 AS kind")
    for target in (None, "kind"):
        got = {}

        def found(got=got, target=target):
            for r in geometry.nearest(v, k=4, target=target).where("query % 500 < 40").orderBy("query", "rank").collect():
                got.setdefault(r["query"], []).append((r["row_idx"], r["distance"]))

        assert max(_held(monkeypatch, found)) <= 42
        monkeypatch.undo()
        rows = np.arange(9000)
        for q, near in got.items():
            d = np.hypot(rows % 7 - q % 7, rows % 3 - q % 3)
            d[q] = np.inf
            if target:
                d[rows % 2 == q % 2] = np.inf
            want = np.lexsort((rows, d))[:4]
            assert near == [(i, pytest.approx(d[i])) for i in want.tolist()]


def test_placement_lands_among_its_neighbours(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(30)], "row_idx long, vec array<double>")
    coords = v.selectExpr("row_idx", "row_idx * 2D AS x", "1D AS y", "IF(row_idx < 15, 'l', 'r') AS side")
    q = spark.createDataFrame([(-1, [4.0, 0.0])], "row_idx long, vec array<double>")
    at, near = geometry.place(q, v, coords, 5)
    r = at.first()
    assert r.x == pytest.approx(8.0, abs=0.5) and r.y == pytest.approx(1.0)
    assert geometry.transfer(near, coords, "side").first().side == "l"
    sigma, rho = geometry.smooth_bandwidths(np.array([[1.0, 2.0, 3.0, 4.0]]), 4, 1.0)
    assert rho[0] == 1.0 and np.exp(-(np.array([1.0, 2.0, 3.0])) / sigma[0]).sum() == pytest.approx(2.0, abs=1e-3)


def test_layout_is_finite_and_keeps_two_groups_apart(spark):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, (rng.normal(0, 1, 4) + 3 * (i % 2)).tolist()) for i in range(40)], "row_idx long, vec array<double>")
    at = {r.node: (r.x, r.y) for r in geometry.layout_2d(geometry.fuzzy_graph(v, 15)).collect()}
    xy = np.array([at[i] for i in range(40)])
    assert np.isfinite(xy).all()
    centres = [xy[k::2].mean(0) for k in (0, 1)]
    own = [np.linalg.norm(xy[i] - centres[i % 2]) < np.linalg.norm(xy[i] - centres[1 - i % 2]) for i in range(40)]
    assert np.mean(own) > 0.9


def test_layout_reaches_the_leading_eigenvectors(spark):
    rng = np.random.default_rng(7)
    n = 90
    w = np.triu((rng.random((n, n)) < 0.06) * rng.random((n, n)), 1)
    w[np.arange(n - 1), np.arange(1, n)] = 0.3
    w = w + w.T
    graph = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(np.triu(w)), strict=True)], "a long, b long, weight double")
    got = np.array([(r.x, r.y) for r in geometry.layout_2d(graph, tolerance=1e-6).orderBy("node").collect()])
    root = np.sqrt(w.sum(1))
    axes = np.linalg.eigh(w / np.outer(root, root))[1][:, ::-1][:, 1:3]
    want = axes / root[:, None]
    assert np.allclose(got, want * np.sign((got * want).sum(0)), atol=1e-4)
    got = np.array([(r.x, r.y) for r in geometry.layout_2d(graph, tolerance=1e-4, coarse=30).orderBy("node").collect()])
    assert np.allclose(got, want * np.sign((got * want).sum(0)), atol=1e-2)
    with pytest.raises(ArithmeticError):
        geometry.layout_2d(graph, tolerance=1e-6, steps=1, coarse=4)


def _residuals(graph, at):
    """Of both axes, over their lengths, and how far they are from each other and from the trivial one."""
    a, b, w = (np.array(c) for c in zip(*graph, strict=True))
    n = max(b.max(), a.max()) + 1
    deg = np.bincount(a, w, n) + np.bincount(b, w, n)
    root = np.sqrt(deg)
    x = np.array([at[i] for i in range(n)]) * root[:, None]
    w = w / (root[a] * root[b])
    moved = np.stack([np.bincount(a, w * x[b, i], n) + np.bincount(b, w * x[a, i], n) for i in range(2)], 1)
    value = (x * moved).sum(0)
    return np.linalg.norm(moved - x * value, axis=0), value, np.abs(np.hstack([x, root[:, None] / np.linalg.norm(root)]).T @ np.hstack([x, root[:, None] / np.linalg.norm(root)]) - np.eye(3)).max()


def test_layout_of_a_long_path(spark):
    path = [(i, i + 1, 1.0) for i in range(3999)]
    at = {r.node: (r.x, r.y) for r in geometry.layout_2d(spark.createDataFrame(path, "a long, b long, weight double")).collect()}
    left, value, off = _residuals(path, at)
    assert (left <= 1.1e-3).all() and (value > 0.9999).all() and off < 1e-6
    x = np.array([at[i][0] for i in range(4000)])
    assert (np.diff(x[::100]) < 0).mean() in (0.0, 1.0)  # from one end to the other


def test_layout_brings_further_axes_along(spark):
    """A path has values close behind the second; two axes alone take more than 60 steps from a start that tells little."""
    path = [(i, i + 1, 1.0) for i in range(119)]
    at = {r.node: (r.x, r.y) for r in geometry.layout_2d(spark.createDataFrame(path, "a long, b long, weight double"), steps=45, coarse=3).collect()}
    left, value, off = _residuals(path, at)
    assert (left <= 1.1e-3).all() and (value > 0.99).all() and off < 1e-6


def test_layout_of_several_parts(spark):
    rng = np.random.default_rng(5)
    parts = [(30 * c + int(i), 30 * c + int(j), float(rng.random())) for c in range(5) for i in range(30) for j in rng.choice(30, 4, replace=False) if i < j]
    parts += [(30 * c + i, 30 * c + i + 1, 0.5) for c in range(5) for i in range(29)]
    graph = spark.createDataFrame(parts, "a long, b long, weight double")
    merged = [(r.a, r.b, r.weight) for r in graph.groupBy("a", "b").sum("weight").toDF("a", "b", "weight").collect()]
    for coarse in (1024, 3):  # 3: more parts than nodes of the contracted graph
        at = {r.node: (r.x, r.y) for r in geometry.layout_2d(graph, coarse=coarse).collect()}
        left, value, off = _residuals(merged, at)
        assert (left <= 1.1e-3).all() and (value > 0.999).all() and off < 1e-6


def clicks(bpm, seconds=20, rate=44_100):
    x = np.zeros(seconds * rate, np.float32)
    for s in np.arange(0, seconds, 60 / bpm):
        i = int(s * rate)
        x[i : i + 200] += np.exp(-np.arange(len(x[i : i + 200])) / 40) * np.sin(np.arange(len(x[i : i + 200])) * 0.8)
    return x


def test_audio():
    for bpm in (120, 174):
        assert abs(audio.tempo(clicks(bpm).astype(float), 44_100)[0] - bpm) < 2
    t = np.arange(8 * 22_050) / 22_050
    chords = sum(np.sin(2 * np.pi * f * t) for f in (220.0, 261.63, 329.63, 440.0))
    assert audio.key(chords, 22_050)[0] == "8A"
    silence = np.zeros(22_050 * 5)
    assert audio.tempo(silence, 22_050) is None and audio.key(silence, 22_050) is None and audio.timbre(silence, 22_050) is None
    noise = np.random.default_rng(0).normal(0, 0.3, 22_050 * 4)
    assert audio.timbre(noise, 22_050)[28] > audio.timbre(chords[: 22_050 * 4], 22_050)[28]
    assert audio.timbre(noise, 22_050).shape == (36,)


def test_clips_fail_alone(spark):
    clips = spark.createDataFrame([("ok", clicks(120, 6).tolist(), 44_100), ("bad", None, 44_100)], "pid string, samples array<float>, sample_rate int")
    got = {r.pid: r for r in audio.analyze_clips(clips).collect()}
    assert abs(got["ok"].bpm - 120) < 3 and got["bad"].error and got["ok"].error is None


def test_exports(spark):
    e = spark.createDataFrame([(1, 1, "p", "A", "T", 1500, 120.4, "8A", "/x.mp3"), (1, 2, "q", None, "U", 2000, None, None, "/no-local-file/q")], "set_id long, pos long, pid string, artist string, name string, duration_ms long, bpm double, key string, location string")
    assert [r.line for r in sinks.m3u8_lines(e).orderBy("line_no").collect()] == ["#EXTM3U", "#PLAYLIST:1", "#EXTINF:2,A - T", "/x.mp3", "#EXTINF:2,Unknown Artist - U", "Unknown Artist - U"]
    assert [r.line for r in sinks.tracklist_lines(e).orderBy("line_no").collect()] == ["01. A - T [8A, 120 BPM]", "02. ? - U"]


def test_xml_round_trip(spark, tmp_path):
    doc = """<?xml version="1.0"?><DJ_PLAYLISTS><COLLECTION Entries="2"><TRACK TrackID="1" Name="A &amp; B" Artist="X" TotalTime="60" AverageBpm="120.00" Tonality="Am" Location="file://localhost/a.mp3"/><TRACK TrackID="2" Name="C" AverageBpm="0.00"/></COLLECTION>
<PLAYLISTS><NODE Type="0" Name="ROOT"><NODE Type="0" Name="Folder"><NODE Type="1" Name="In" KeyType="0"><TRACK Key="1"/><TRACK Key="2"/></NODE></NODE></NODE></PLAYLISTS></DJ_PLAYLISTS>"""
    (tmp_path / "c.xml").write_text(doc)
    t = readers.read_xml_tracks(spark, str(tmp_path / "c.xml")).orderBy("track_id").collect()
    assert [(r.name, r.bpm, r.key, r.duration_ms) for r in t] == [("A & B", 120.0, "8A", 60_000), ("C", None, None, 0)]
    p = readers.read_xml_playlists(spark, str(tmp_path / "c.xml")).orderBy("pos").collect()
    assert [(r.playlist, r.key_type, r.key) for r in p] == [("Folder / In", 0, "1"), ("Folder / In", 0, "2")]
    assert [r.format for r in readers.route(spark, str(tmp_path)).collect()] == ["xml"]


def test_plist_and_text_exports(spark, tmp_path):
    import plistlib

    doc = {"Tracks": {"1": {"Track ID": 1, "Persistent ID": "P", "Name": "N", "Total Time": 1000, "BPM": 120}, "2": {"Track ID": 2, "Name": "no id"}}, "Playlists": [{"Name": "L", "Master": True}, {"Name": "M", "Playlist Items": [{"Track ID": 1}]}]}
    (tmp_path / "l.xml").write_bytes(plistlib.dumps(doc))
    assert [(r.pid, r.bpm) for r in readers.read_plist_tracks(spark, str(tmp_path / "l.xml")).collect()] == [("P", 120.0)]
    assert [(r.playlist, r.master, r.track_id) for r in readers.read_plist_playlists(spark, str(tmp_path / "l.xml")).orderBy("list_pos").collect()] == [("L", True, None), ("M", False, 1)]
    lines = ["\t".join(readers.TEXT_COLUMNS), "\t".join(["1", "", "Title", "Art", "", "House", "128.00", "", "03:30", "8A", "2024-01-02"]), "\t".join(["2", *[""] * 10])]
    (tmp_path / "t.txt").write_bytes("\n".join(lines).encode("utf-16"))
    r = readers.read_text_export(spark, str(tmp_path / "t.txt")).collect()
    assert [(x.name, x.tempo, x.camelot, x.duration_ms) for x in r] == [("Title", 128.0, "8A", 210_000)]


def test_empty_tables(spark):
    t = spark.createDataFrame([], "pid string, row_idx long, bpm double, key string, confidence double, genre string, artist string, year int, collection string, label string, cluster long, duration_ms long, name string")
    p = spark.createDataFrame([], "row_idx long, x double, y double, cluster int, collection string")
    m = spark.createDataFrame([], "playlist string, pid string")
    for f in (sets.suggest_next(t), analytics.coverage(t), analytics.find_gaps(p), analytics.cluster_labels(t), library.merge_memberships(m, m, m.selectExpr("playlist", "pid AS free")), analytics.neighborhoods(t)):
        assert f.count() == 0


def test_outside_tracks_land_beside_their_like(spark):
    from tonegrid.operators import placement

    t = spark.createDataFrame([(i, f"p{i}", 100.0 + i % 2 * 60, f"{1 + i % 2 * 6}A", 2000, 200_000 + i, f"g{i % 2}", f"L{i % 2}", f"a{i % 4}") for i in range(40)], "row_idx long, pid string, bpm double, key string, year int, duration_ms long, genre string, label string, artist string")
    m = t.limit(3).select(F.lit("pl").alias("playlist"), "pid")
    rows, encoder = features.fit_features(t, m, features.SIMILARITY)
    vec = features.vectors(rows, encoder, t)
    reduced, basis = geometry.reduce_dims(vec, 3)
    at = t.selectExpr("pid", "row_idx", "(row_idx % 2) * 10D AS x", "0D AS y", "CAST(row_idx % 2 AS INT) AS cluster")
    out = t.where("row_idx in (4, 5)").withColumn("row_idx", F.col("row_idx") + 1000).withColumn("pid", F.concat(F.lit("ext:"), "pid")).withColumn("genre", F.lit(None).cast("string"))
    placed = placement.place_outside(out, encoder, basis, reduced, at, t, 5)
    got = {r.pid: r for r in placed.collect()}
    assert (got["ext:p4"].cluster, got["ext:p4"].genre, got["ext:p4"].projected) == (0, "g0", True) and got["ext:p5"].x == pytest.approx(10.0)
    grown = placement.attach_outside(at, placed)
    assert grown.count() == 42 and placement.attach_outside(grown, placed).count() == 42
    edited = t.withColumn("source_key", F.when(F.col("row_idx") == 4, "manual")).withColumn("source_bpm", F.lit(None).cast("string")).withColumn("bpm", F.when(F.col("row_idx") == 4, 160.0).otherwise(F.col("bpm"))).withColumn("key", F.when(F.col("row_idx") == 4, "7A").otherwise(F.col("key")))
    moved = {r.pid: r for r in placement.move_edited(edited, at, 5).collect()}
    assert (moved["p4"].cluster, moved["p4"].x) == (1, pytest.approx(10.0)) and moved["p6"].x == 0.0


def test_many_polygons_equal_a_loop(spark):
    rng = np.random.default_rng(11)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([rng.normal(0, 2, (300, 2)), rng.integers(-3, 4, (60, 2))]))] + [(900, None, 1.0)]
    shapes = {n: [tuple(map(float, c)) for c in rng.normal(0, scale, (int(rng.integers(3, 8)), 2)) + rng.normal(0, 2, 2)] for n, scale in enumerate([0.05, 0.3, 1, 1, 5, 40])}
    shapes |= {10: [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)], 11: [(0.0, 0.0), (1.0, 1.0)], 12: [(1.0, 1.0)] * 3, 13: [(-1e6, -1e6), (1e6, -1e6), (0.0, 1e6)]}
    p = spark.createDataFrame(pts, "row_idx long, x double, y double")
    g = spark.createDataFrame([(n, [*map(tuple, c)] + [None] * (n == 10)) for n, c in shapes.items()], "polygon_id long, corners array<struct<x: double, y: double>>")

    def inside(x, y, c):
        return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(c, [*c[1:], c[0]], strict=True)) % 2 == 1

    want = sorted((n, i) for n, c in shapes.items() if len(c) > 2 for i, x, y in pts if x is not None and inside(x, y, c))
    assert rows(query.in_polygons(p, g), "polygon_id", "row_idx") == want
    assert query.in_polygons(p, g.limit(0)).count() == 0


def test_ambiguous_files_are_listed(spark):
    t = spark.createDataFrame([("a", "file://localhost/m/x/Song.mp3"), ("b", "file:///m/y/other.mp3"), ("c", "/no-local-file/s.mp3"), ("d", None), ("e", "/q/once.mp3")], "pid string, location string")
    f = spark.createDataFrame([(1, "p/x/song.mp3"), (2, "r/x/song.mp3"), (3, "r/z/song.mp3"), (4, "k/other.mp3"), (5, "l/other.mp3"), (6, "o/once.mp3")], "file_id long, path string")
    assert rows(linkage.ambiguous_files(t, f, "/no-local-file/"), "pid", "file_id") == [("a", 1, 2), ("a", 2, 2), ("b", 4, 1), ("b", 5, 1)]


def test_first_centres_are_far_apart_and_need_few_jobs(spark):
    rng = np.random.default_rng(4)
    spots = [(10.0 * i, 10.0 * j) for i in range(4) for j in range(3)]
    p = spark.createDataFrame([(n, x + float(rng.normal(0, 0.1)), y + float(rng.normal(0, 0.1))) for n, (x, y) in enumerate(spots * 30)], "row_idx long, x double, y double")
    found = geometry.seed_centres(p, 12)
    assert sorted({(round(x / 10), round(y / 10)) for x, y in found}) == sorted((int(x / 10), int(y / 10)) for x, y in spots)
    assert found == geometry.seed_centres(p.repartition(7), 12)
    few = spark.createDataFrame([(i, float(i % 3), 0.0) for i in range(50)], "row_idx long, x double, y double")
    assert sorted(geometry.seed_centres(few, 5)) == [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]
    assert geometry.seed_centres(few.limit(0), 5) == []


def test_factored_blend_equals_the_spread_one(spark):
    rng = np.random.default_rng(8)
    t = spark.createDataFrame([(i, None if i % 9 == 0 else f"a{int(rng.integers(8))}") for i in range(60)] + [(60, "lone")], "row_idx long, artist string")
    values = {(int(rng.integers(61)), f"t{int(rng.integers(6))}"): float(rng.random()) for _ in range(120)}
    r = spark.createDataFrame([(i, "playlist", term, v) for (i, term), v in values.items()] + [(0, "genre", "g", 1.0)], "row_idx long, block string, term string, value double")
    for blend in (0.3, 1.0):
        f = features.artist_factors(r, t, blend)
        dense = np.zeros((61, 6))
        for x in features.blend_artists(r, t, blend).where("block = 'playlist'").collect():
            dense[x.row_idx, int(x.term[1])] = x.value
        assert features.blended_energy(f) == pytest.approx((dense**2).sum())
        gram = np.zeros((6, 6))
        for x in features.blended_gram(f).collect():
            gram[int(x.a[1]), int(x.b[1])] = gram[int(x.b[1]), int(x.a[1])] = x.value
        assert np.allclose(gram, dense.T @ dense)


def test_a_fit_does_not_spread_a_hot_artist(spark):
    """20,000 tracks of one artist in 500 playlists would be ten million mixed values."""
    n, lists = 20_000, 500
    t = spark.range(n).selectExpr("id AS row_idx", "'p' || id AS pid", "'Various' AS artist", "CAST(NULL AS STRING) AS genre", "CAST(NULL AS STRING) AS label", "120D AS bpm", "'8A' AS key", "2000 AS year", "1000L AS duration_ms")
    m = spark.range(n).selectExpr(f"'l' || id % {lists} AS playlist", "'p' || id AS pid")
    options = features.Options()
    _, fit = features.fit_features(t, m, options)
    idf, b = np.log(n / (n / lists)), options.artist_blend
    energy = n * ((1 - b) ** 2 * idf**2 + b * (2 - b) * lists * (idf / lists) ** 2)
    assert fit.scales["playlist"] == pytest.approx(options.weight("playlist") / np.sqrt(energy / n))


def test_outstanding_note_counts_every_track(spark, tmp_path):
    from tonegrid.plans import details

    part = spark.range(1, 61).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size", "1.0D AS p_retailprice")
    part.write.parquet(str(tmp_path / "part.parquet"))
    got = {r.collection: r for r in details.outstanding_note(spark, str(tmp_path)).collect()}
    assert {c: r.total for c, r in got.items()} == {"c0": 20, "c1": 20, "c2": 20} and got["c1"].complete and not got["c0"].complete
    assert {r.note for r in got.values()} == {f"Missing BPM or key: c0 ({got['c0'].incomplete} of 20), c2 ({got['c2'].incomplete} of 20). Skipping c1, already complete."}


def test_clips_are_made_where_they_are_heard(spark, tmp_path):
    from tonegrid.plans import queries

    spark.range(1, 6001).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    assert queries.analyze_clips(spark, str(tmp_path)).rdd.getNumPartitions() == 24  # grows with the suppliers
    one = queries._clips(spark, str(tmp_path)).where("pid = '30'").first()
    assert len(one.samples) == 48_000 and abs(one.samples[1] - math.sin(220 * 2**0.5 * 2 * math.pi / 8000) * math.exp(-1 / 400)) < 1e-6


def test_xml_is_split_among_tasks(spark, tmp_path):
    lists = "".join(f'<NODE Type="1" Name="L&amp;{n}" KeyType="0">' + "".join(f'<TRACK Key="{n * i}"/>' if i % 3 else f"<TRACK\n Key='{n * i}'></TRACK>" for i in range(n % 7 * 10)) + "</NODE>" for n in range(30))
    tracks = "".join(f'<TRACK TrackID="{i}" Name="a > {i}" AverageBpm="120.00"><TEMPO Inizio="0"/></TRACK>' for i in range(200))
    doc = f'<?xml version="1.0" encoding="UTF-8"?>\n<!-- made here -->\n<DJ_PLAYLISTS><COLLECTION>{tracks}</COLLECTION><PLAYLISTS><NODE Type="0" Name="ROOT"><NODE Type="0" Name="é"><NODE Type="1" Name="empty"/>{lists}</NODE></NODE></PLAYLISTS></DJ_PLAYLISTS>'
    (tmp_path / "c.xml").write_text(doc)
    (tmp_path / "odd.xml").write_text(doc.replace("made here", "<TRACK TrackID='7' Name='no'/>"))
    (tmp_path / "cut.xml").write_text(doc.removesuffix("</PLAYLISTS></DJ_PLAYLISTS>"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        found = readers.read_xml_playlists(spark, str(tmp_path / "c.xml"))
        assert found.rdd.getNumPartitions() > 10 and readers.read_xml_tracks(spark, str(tmp_path / "c.xml")).rdd.getNumPartitions() > 10
        got = sorted(map(tuple, found.select("playlist", "key_type", "key", "pos").collect()))
        assert got == sorted((r["playlist"], r["key_type"], r["key"], r["pos"]) for r in readers._xml_lists(doc.encode())) and len(got) > 800
        assert sorted(r.name for r in readers.read_xml_tracks(spark, str(tmp_path / "c.xml")).collect()) == sorted(f"a > {i}" for i in range(200))
        assert readers.read_xml_tracks(spark, str(tmp_path / "odd.xml")).count() == 200
        assert readers.read_xml_playlists(spark, str(tmp_path / "odd.xml")).count() == len(got)
        with pytest.raises(ValueError, match="ends inside"):
            readers.read_xml_playlists(spark, str(tmp_path / "cut.xml"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_totals_of_a_blend_need_no_spreading(spark):
    t = spark.createDataFrame([(i, None if i == 9 else "lone" if i == 8 else "ab"[i % 2]) for i in range(12)], "row_idx long, artist string")
    r = spark.createDataFrame([(i, "playlist", f"p{i * j % 7}", float(i + 1)) for i in range(10) for j in (1, 2, 3)], "row_idx long, block string, term string, value double").distinct()
    f = features.artist_factors(r, t, 0.3)
    totals = features.blended_totals(f)
    want = features.blend_artists(r, t, 0.3).groupBy("row_idx").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    got, want = ({x.row_idx: (x.n, round(x.total, 9)) for x in d.collect()} for d in (totals, want))
    assert got == want and len(got) == 12
    hot = spark.range(3000).selectExpr("id AS row_idx", "'one' AS artist")
    own = hot.selectExpr("row_idx", "'playlist' AS block", "CAST(row_idx AS string) AS term", "1.0D AS value")
    assert features.blended_totals(features.artist_factors(own, hot, 0.3)).agg(F.min("n"), F.max("n"), F.count("*")).first()[:] == (3000, 3000, 3000)  # 9,000,000 values are not made


def test_next_tracks_are_not_ranked_track_by_track(spark):
    t = spark.createDataFrame([(i, f"p{i}", 120.0, "8A", 1.0) for i in range(6)], "row_idx long, pid string, bpm double, key string, confidence double")
    out = sets.suggest_next(t, k=3)
    assert [(r.rank, r.to_pid) for r in out.where("pid = 'p1'").orderBy("rank").collect()] == [(1, "p0"), (2, "p2"), (3, "p3")]
    assert not [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "windowspecdefinition(pid" in line]


def test_sets_are_judged_by_keys_read_once_a_track(spark):
    t = spark.createDataFrame([("a", 0, 120.0, "8A", 1.0), ("b", 1, 130.0, "11B", 1.0), ("c", 2, None, None, 1.0)], TRACK)
    out = sets.evaluate_sets(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "set_id long, pos int, pid string"), t)
    assert [(r.pos, r.compat, r.delta_pct, [w.kind for w in r.warnings]) for r in out.orderBy("pos").collect()] == [(2, "clash", 8.3, ["key", "bpm"]), (3, None, None, ["key-unknown", "bpm-unknown"])]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan[: plan.index("Window")] and "regexp_extract" in plan


def test_fits_share_their_terms_and_read_them_once(spark, monkeypatch):
    t = spark.createDataFrame([(f"p{i}", i, 90.0 + i, "8A", 1.0, 2000 + i, 200000, ["house", "techno"][i % 2], ["x", "y", None][i % 3], f"a{i % 4}") for i in range(12)], TRACK + ", year int, duration_ms long, genre string, label string, artist string")
    m = spark.createDataFrame([(f"l{i % 3}", f"p{i}") for i in range(12)], "playlist string, pid string")
    terms, told = features.known_terms(t, m), lambda f: sorted((r.row_idx, r.block, r.term, round(r.value, 9)) for r in f.collect())
    energies = []
    scales = features.block_scales
    monkeypatch.setattr(features, "block_scales", lambda rows, *a, **k: energies.append({r[0] for r in rows.select("block").distinct().collect()}) or scales(rows, *a, **k))
    for excluded in ((), ("genre",), ("label",), ("playlists",)):
        options = features.Options(exclude=frozenset(excluded), artist_blend=0.0)
        rows, encoder = features.fit_features(t, m, options, terms=terms)
        own, alone = features.fit_features(t, m, options)
        assert told(rows) == told(own) and encoder.scales == pytest.approx(alone.scales)
        for block in encoder.scales:  # a block's energy is its weight's square times its rows, with or without the rows of its terms
            over = 8 if block == "label" else 12
            assert rows.where(rows.block == block).agg(F.sum(F.col("value") ** 2)).first()[0] == pytest.approx(options.weight(block) ** 2 * over)
    assert set().union(*energies) == {"numeric"}


def test_playlists_meet_tracks_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(lineage, "TASK_ROWS", 10)
    t = spark.createDataFrame([("f", i, i, f"p{i}", f"/{i}") for i in range(20)] + [("f", 3, 99, "late", "/3")], "file string, track_id long, row_idx long, pid string, location string")
    items = spark.createDataFrame([("f", f"l{i % 4}", i % 25, i) for i in range(100)], "file string, playlist string, track_id long, pos long")
    met = library.join_playlist_items(items, t)
    assert met.count() == 80 and {r.pid for r in met.where("pos = 3").collect()} == {"late"}
    refs = items.select("file", "playlist", F.when(F.col("pos") % 2 == 0, 0).otherwise(1).alias("key_type"), F.expr("if(pos % 2 = 0, CAST(track_id AS STRING), '/' || CAST(track_id AS STRING))").alias("key"), "pos")
    told = library.join_playlist_refs(refs, t)
    want = {("l%d" % (i % 4), "late" if i % 25 == 3 else f"p{i % 25}"): i for i in reversed(range(100)) if i % 25 < 20 and not (i % 2 == 0 and i % 25 == 0)}
    assert {(r.playlist, r.pid): r.pos for r in told.collect()} == want
    for f in (met, told):  # nothing is broadcast, and rows are dealt by their number
        plan = f._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "REPARTITION_BY_NUM" in plan


def test_playlists_of_clusters_are_counted_without_sorting(spark):
    t = spark.createDataFrame([("a", 0, 0, "house", "x"), ("b", 1, 0, "house", "y")], "pid string, row_idx long, cluster int, genre string, artist string")
    m = spark.createDataFrame([("z", "a"), ("y", "a"), ("x", "b")], "playlist string, pid string")
    out = analytics.summarize_clusters(t, m)
    assert out.first().playlists == ["y", "z", "x"]  # one row's playlists by name
    assert "seen_at" not in out._jdf.queryExecution().optimizedPlan().toString()
