"""Keys, tempos and text forms on single values."""

import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonegrid.functions import music, text
from tonegrid.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()[0]


@pytest.mark.parametrize(("spelled", "code"), [
    ("8A", "8A"), ("08b", "8B"), (" 12A ", "12A"), ("13A", None), ("1m", "8A"), ("1d", "8B"), ("6d", "1B"), ("Am", "8A"), ("C", "8B"), ("F# minor", "11A"), ("Ebmaj", "5B"), ("D♭", "3B"), ("C#min", "12A"), ("H", None), ("", None), (None, None), ("Fb", "12B"),
])
def test_spellings_of_keys(spark, spelled, code):
    assert one(spark, music.to_camelot(F.lit(spelled).cast("string"))) == code


@pytest.mark.parametrize(("a", "b", "kind"), [("8A", "8A", "same"), ("8A", "8B", "relative"), ("12A", "1A", "adjacent"), ("8A", "9B", "near"), ("8A", "10A", "clash"), ("8A", "x", None)])
def test_compatibility(spark, a, b, kind):
    assert one(spark, music.key_compatibility(F.lit(a), F.lit(b))) == kind


@pytest.mark.parametrize(("a", "b", "pct"), [(120, 120, 0.0), (70, 140, 0.0), (120, 126, 5.0), (128, 136, 6.3), (0, 100, None)])
def test_tempo_distance(spark, a, b, pct):
    assert one(spark, music.bpm_delta_pct(F.lit(float(a)), F.lit(float(b)))) == pct


def test_display_and_vector(spark):
    assert one(spark, music.camelot_display(F.lit("8A"))) == "8A (Am)"
    assert one(spark, music.camelot_display(F.lit("11B"))) == "11B (A)"
    assert one(spark, music.key_vector(F.lit("1B"))) == pytest.approx([0.0, 1.0, 0.0])


@pytest.mark.parametrize(("title", "form"), [
    ("Song (Radio Edit) [feat. X]", "song"), ("Tïtle - Extended Mix", "title"), ("夜mix", "夜mix"), ("Don't Stop (2 Hearts)", "dont stop (2 hearts)"), ("(Live)", "(live)"), ("Foo ft. Bar", "foo"), ("A  B", "a b"),
])
def test_titles(title, form):
    assert text.title_form(title) == form


@pytest.mark.parametrize(("raw", "artist", "form"), [("Foo Records, Ltd.", None, "Foo Records"), ("Sony/Bar Music", "Bar", "Sony"), ("Beatport", None, None), ("  ", None, None), ("The Orchard / Night", None, "Night")])
def test_labels(raw, artist, form):
    assert text.label_form(raw, artist) == form


@given(st.text(max_size=30))
def test_forms_are_stable(title):
    form = text.title_form(title)
    assert text.search_form(form) == text.search_form(text.search_form(form))
    assert len(text.hash64(title)) == 16


def test_paths_and_links(spark):
    assert one(spark, text.decode_location(F.lit("file://localhost/a%20b/c+d.mp3"))) == "/a b/c+d.mp3"
    assert one(spark, text.decode_location(F.lit("/bad%zz"))) == "/bad%zz"
    assert one(spark, text.path_segments(F.lit("C:\\x\\\\y/z"))) == ["C:", "x", "y", "z"]
    assert one(spark, text.clock_ms(F.lit("01:02:03"))) == 3_723_000
    assert one(spark, text.clock_ms(F.lit("7"))) is None
    assert one(spark, text.preview_usable(F.lit("u?exp=100"), F.lit(30_000))) is True
    assert one(spark, text.preview_usable(F.lit("u?exp=100"), F.lit(50_000))) is False
    assert one(spark, text.search_url(F.lit("a b"), F.lit(" "))).endswith("=a%20b")


def test_hashes_of_a_batch_equal_one_by_one():
    rng = random.Random(3)
    texts = ["", "a", "𝄞 clef", "\ud800", "x" * 5000, *("".join(rng.choices("abcdé米 ", k=rng.randrange(60))) for _ in range(300))]

    def plain(s):
        a, b = 0x811C9DC5, 0x01000193
        raw = s.encode("utf-16-le", "surrogatepass")
        for i in range(0, len(raw), 2):
            unit = raw[i] | raw[i + 1] << 8
            a, b = ((a ^ unit) * 0x01000193) & 0xFFFFFFFF, ((b ^ unit) * 0x85EBCA6B) & 0xFFFFFFFF
        return f"{a:08x}{b:08x}"

    want = [plain(s) for s in texts]
    assert text.hashes64(texts) == want == [text.hash64(s) for s in texts] and text.hashes64([]) == []


def test_hash_column_keeps_nulls(spark):
    got = [r[0] for r in spark.createDataFrame([("a",), (None,), ("",)], "s string").select(text.hash_64(F.col("s"))).collect()]
    assert got == [text.hash64("a"), None, text.hash64("")]


def test_checkpoints_first_file_wins(spark, tmp_path):
    for name, rows in (("one", [("x", "matched", 120.0), ("y", "no-match", None)]), ("two", [("y", "matched", 90.0), ("z", "http-error", None), ("z", "matched", 1.0)])):
        results = [{"pid": p, "artist": "a", "title": "t", "status": s, "via": "combined", "rawTempo": r} for p, s, r in rows]
        (tmp_path / f"{name}.json").write_text(json.dumps({"seed": 42, "results": results}, indent=1))
    found = readers.read_checkpoints(spark, [str(tmp_path / "one.json"), str(tmp_path / "two.json")])
    assert sorted((r.pid, r.status, r.rawTempo) for r in found.collect()) == [("x", "matched", 120.0), ("y", "no-match", None), ("z", "http-error", None)]
