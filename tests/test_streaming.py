"""Streams end in the table that the batch form makes."""

import shutil
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tonegrid.operators import enrich
from tonegrid.operators.library import Library, merge, merge_tracks
from tonegrid.plans import details  # noqa: F401  registers the queries
from tonegrid.plans.queries import QUERIES
from tonegrid.streaming import jobs

SCHEMA = "pid string, row_idx long, name string"


def test_import_equals_batch(spark, tmp_path):
    a = spark.createDataFrame([("x", 0, "a"), ("y", 1, "b")], SCHEMA)
    b = spark.createDataFrame([("x", 0, "later"), ("z", 1, "c")], SCHEMA)
    for f in (a, b):
        f.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.stream_import(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    got = sorted(tuple(r) for r in jobs.read_table(spark, str(tmp_path / "table")).collect())
    assert got == sorted(tuple(r) for r in merge_tracks(a, b).collect())


def test_a_batch_leaves_other_parts_alone(spark, tmp_path):
    for n, part in enumerate((range(0, 300), range(300, 303))):
        spark.createDataFrame([(f"p{i}", i, "n") for i in part], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.stream_import(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
        files = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "table").rglob("*.parquet")}
        if n == 0:
            old = files
    assert jobs.read_table(spark, str(tmp_path / "table")).count() == 303
    assert len(old.items() - files.items()) <= 3


def test_batches_without_rows(spark, tmp_path):
    """A file may have none, the first one of all too: its task had nothing to write."""
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("x", 0, "a")], SCHEMA)
    (tmp_path / "table").mkdir()  # as a write that broke off leaves it
    for f, want in ((none, []), (some, [("x", 0, "a")]), (none, [("x", 0, "a")])):
        f.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.stream_import(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
        got = jobs.read_table(spark, str(tmp_path / "table"))
        assert got.columns == none.columns and [tuple(r) for r in got.collect()] == want


def test_lookup_queue_without_events(spark, tmp_path):
    """The first batch has no rows, and there is no last event."""
    events, part = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("events", "part"))
    events.limit(0).write.parquet(str(tmp_path / "events.parquet"))
    part.where("p_partkey < 60").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(tuple(r) for r in QUERIES["lookup_queue"](spark, str(tmp_path)).collect())
    assert got == sorted((f"rb:{i}", f) for i in range(60) for f, n in (("bpm", 5), ("key", 6), ("label", 4)) if i % n == 0)


def test_answers_land_first_wins(spark, tmp_path):
    tracks = spark.createDataFrame([("x", None, None, "House", None), ("y", 120.0, "8A", None, None)], "pid string, bpm double, key string, genre string, label string")
    schema = "pid string, bpm double, key string, label string, source string"
    for bpm in (90.0, 100.0):
        spark.createDataFrame([("x", bpm, "9A", None, "s"), ("y", 1.0, "1A", "L", "s")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.stream_enrich(spark, str(tmp_path / "in"), schema, tracks, str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    got = {r.pid: r for r in jobs.read_table(spark, str(tmp_path / "table")).collect()}
    assert (got["x"].bpm, got["x"].key, got["y"].bpm, got["y"].label) == (90.0, "9A", 120.0, "L")


def test_placing_appends(spark, tmp_path):
    spark.createDataFrame([("n", 3.0)], "pid string, v double").write.parquet(str(tmp_path / "in"))
    jobs.stream_place(spark, str(tmp_path / "in"), "pid string, v double", lambda b: b.selectExpr("pid", "v * 2 AS x"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("pid", "x").first() == ("n", 6.0)


TRACK = "pid string, row_idx bigint, collection string, name string"


def _library(spark, tracks, members, collections):
    return Library(spark.createDataFrame(tracks, TRACK), spark.createDataFrame(members, "playlist string, pid string"), spark.createDataFrame(collections, "id string, label string, pos int, track_count bigint"))


def _rows(found):
    return [sorted(tuple(r[c] for c in sorted(f.columns)) for r in f.collect()) for f in found]


def test_whole_imports_equal_the_batch_merge(spark, tmp_path):
    first = _library(spark, [("x", 0, "a", "one"), ("y", 1, "a", "two"), ("y", 2, "a", "again")], [("set", "x"), ("set", "x")], [("a", "First", 0, 2)])
    second = _library(spark, [("x", 0, "b", "later"), ("z", 1, "b", "three")], [("set", "x"), ("other", "z")], [("b", "Second", 0, 9), ("c", "Empty", 1, 4)])
    third = _library(spark, [("w", 0, "d", "four")], [("set", "w"), ("set [Second]", "y")], [("d", "Third", 0, 1)])
    steps = [(first, "First"), (second, "Second"), (second, "Second"), (third, "Second"), (first, "First")]
    run = lambda: jobs.stream_library(spark, str(tmp_path / "in"), TRACK, str(tmp_path / "store")).awaitTermination()
    want = None
    for found, label in steps:
        jobs.import_rows(found, label).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
        want = merge(Library(*(f.limit(0) for f in found)), found, label) if want is None else merge(want, found, label)
        assert _rows(jobs.read_library(spark, str(tmp_path / "store"))) == _rows(want)
    commits = spark.read.parquet(str(tmp_path / "store" / "commits")).orderBy("batch").collect()
    assert [(r.added, r.redundant) for r in commits] == [(2, False), (1, False), (0, True), (1, False), (0, True)]


def test_a_batch_that_broke_off_or_runs_again_adds_nothing_twice(spark, tmp_path):
    store = tmp_path / "store"
    run = lambda: jobs.stream_library(spark, str(tmp_path / "in"), TRACK, str(store)).awaitTermination()
    for i, pids in enumerate(("xy", "xz")):
        found = _library(spark, [(p, n, f"c{i}", p) for n, p in enumerate(pids)], [("set", p) for p in pids], [(f"c{i}", f"C{i}", 0, 2)])
        jobs.import_rows(found, f"C{i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    whole = _rows(jobs.read_library(spark, str(store)))
    progress = [store / "_progress" / "commits" / n for n in ("1", ".1.crc")]
    for p in progress:  # the stream forgets that it finished: a repeat after the commit
        p.unlink(missing_ok=True)
    stamp = {f: f.stat().st_mtime_ns for f in (store / "tracks").rglob("*.parquet")}
    run()
    assert stamp == {f: f.stat().st_mtime_ns for f in (store / "tracks").rglob("*.parquet")} and _rows(jobs.read_library(spark, str(store))) == whole
    for p in progress:
        p.unlink(missing_ok=True)
    shutil.rmtree(store / "commits" / "batch=1")  # broke off before its commit: its files are there, unread
    assert len(_rows(jobs.read_library(spark, str(store)))[0]) == 2
    run()
    assert _rows(jobs.read_library(spark, str(store))) == whole


def test_a_large_library_is_a_start(spark, tmp_path):
    base = _library(spark, [("x", 0, "a", "one")], [("set", "x")], [("a", "First", 0, 1)])
    jobs.start_library(base, str(tmp_path / "store"))
    assert _rows(jobs.read_library(spark, str(tmp_path / "store"))) == _rows(base)
    more = _library(spark, [("x", 0, "b", "later"), ("z", 1, "b", "two")], [("set", "z")], [("b", "Second", 0, 2)])
    jobs.import_rows(more, "Second").coalesce(1).write.parquet(str(tmp_path / "in"))
    jobs.stream_library(spark, str(tmp_path / "in"), TRACK, str(tmp_path / "store")).awaitTermination()
    assert _rows(jobs.read_library(spark, str(tmp_path / "store"))) == _rows(merge(base, more, "Second"))


DAY = datetime(2024, 5, 1)


def _event(pid, day, need=None, status=None, covered=None, have=None):
    return (pid, DAY + timedelta(days=day), need, status, covered, have)


def test_lookups_stop_and_resume(spark, tmp_path):
    files = [
        [_event("x", 0, ["bpm", "key"]), _event("y", 0, ["bpm", "label"]), _event("q", 0, ["tags"]), _event(None, 0, ["bpm"])],
        [_event("x", 1, None, "hit", ["bpm"], ["bpm"]), _event("y", 1, None, "miss", ["bpm", "key"]), _event("q", 1, None, "error", ["tags"])],
        [_event("y", 3, None, "hit", [], ["label"]), _event("x", 2, None, "miss", ["key"]), _event("late", 2, None, "hit", ["bpm"], ["bpm"])],
        [_event("x", -1, ["tags"]), _event("late", 0, ["bpm", "key"]), _event("x", 0, None, "miss", ["key"])],
    ]
    events = [spark.createDataFrame(f, enrich.LOOKUP_EVENTS) for f in files]
    found = lambda states, day: {r.pid: r.outstanding for r in enrich.outstanding_lookups(states, F.lit(DAY + timedelta(days=day))).collect()}
    for n, e in enumerate(events):
        e.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n in (1, 3):  # two files while it stood still
            jobs.stream_lookups(spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "check"), parts=4).awaitTermination()
    got = jobs.read_table(spark, str(tmp_path / "table"))
    whole = enrich.lookup_states(events[0].unionByName(events[1]).unionByName(events[2]).unionByName(events[3]))
    for day, want in ((7.9, {"q": ["tags"], "late": ["key"]}), (8.0, {"q": ["tags"], "late": ["key"], "y": ["bpm"]}), (9.0, {"q": ["tags"], "late": ["key"], "y": ["bpm"], "x": ["key"]})):
        assert found(got, day) == found(whole, day) == want
