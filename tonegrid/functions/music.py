"""Column functions for musical keys and tempos, all inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key spellings, the plausible tempo band, genres that do not sit below 100 BPM.
CAMELOT = r"^0*(\d{1,2})\s*([ABab])$"
OPEN_KEY = r"^0?(\d{1,2})\s*([mMdD])$"
CLASSICAL = r"^([A-Ga-g])([#b]?)\s*(major|maj|minor|min|m)?\.?$"
# The semitone of each letter.
SEMITONES = {"c": 0, "d": 2, "e": 4, "f": 5, "g": 7, "a": 9, "b": 11}
NOTE_NAMES = ("C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B")
BPM_LOW, BPM_HIGH = 60, 200
DANCE = r"(?i)house|techno|trance|electro|dance|edm|drum\s*&?\s*bass|dnb|garage|hardstyle|disco"
SPACE_ENDS = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounds halves upwards, as floor(x + 0.5) at the given digit."""
    unit = 10**digits
    return F.floor(value * unit + 0.5) / unit


def camelot_of_pitch(pitch: Column, minor: Column) -> Column:
    """Camelot code of a tonic (C = 0): one step on the wheel is a fifth, and a minor key sits with its relative major."""
    major = pitch + F.when(minor, 3).otherwise(0)
    return F.concat((F.pmod(major * 7 + 7, F.lit(12)) + 1).cast("int").cast("string"), F.when(minor, "A").otherwise("B"))


def to_camelot(key: Column) -> Column:
    """Camelot code of a key spelled as Camelot, Open Key or a note with a mode; null if it is none of these."""
    s = F.translate(F.regexp_replace(key, SPACE_ENDS, ""), "♯♭", "#b")
    part = lambda pattern, i: F.regexp_extract(s, pattern, i)
    number = lambda pattern: part(pattern, 1).try_cast("int")
    valid = lambda n: n.between(1, 12)
    wheel = F.when(valid(number(CAMELOT)), F.concat(number(CAMELOT).cast("string"), F.upper(part(CAMELOT, 2))))
    opened = F.when(valid(number(OPEN_KEY)), F.concat((F.pmod(number(OPEN_KEY) + 6, F.lit(12)) + 1).cast("string"), F.when(F.lower(part(OPEN_KEY, 2)) == "m", "A").otherwise("B")))
    steps = F.create_map(*(F.lit(x) for letter in SEMITONES.items() for x in letter))[F.lower(part(CLASSICAL, 1))]
    pitch = F.pmod(steps + F.when(part(CLASSICAL, 2) == "#", 1).when(part(CLASSICAL, 2) == "b", -1).otherwise(0), F.lit(12))
    minor = part(CLASSICAL, 3).isin("m", "min", "minor")
    classical = F.when(part(CLASSICAL, 1) != "", camelot_of_pitch(pitch, minor))
    return F.coalesce(wheel, opened, classical)


def camelot_number(key: Column) -> Column:
    """Place on the wheel, 1 to 12; null if the key is no Camelot code."""
    return F.regexp_extract(key, r"^(0?[1-9]|1[0-2])\s*[ABab]$", 1).try_cast("int")


def camelot_minor(key: Column) -> Column:
    return F.when(camelot_number(key).isNotNull(), F.upper(F.substring(key, -1, 1)) == "A")


def key_vector(key: Column) -> Column:
    """(sin, cos, minor bit) of the place on the wheel; null without a code."""
    angle = (camelot_number(key) - 1) * (2 * math.pi / 12)
    return F.when(camelot_number(key).isNotNull(), F.array(F.sin(angle), F.cos(angle), camelot_minor(key).cast("double")))


def key_compatibility(a: Column, b: Column) -> Column:
    """same, relative, adjacent, near or clash; null unless both are codes."""
    return wheel_compatibility(camelot_number(a), camelot_minor(a), camelot_number(b), camelot_minor(b))


def wheel_compatibility(a: Column, minor_a: Column, b: Column, minor_b: Column) -> Column:
    """``key_compatibility`` of places on the wheel and their modes."""
    apart = F.pmod(a - b, F.lit(12))
    apart = F.least(apart, F.lit(12) - apart)
    alike = minor_a == minor_b
    return F.when(apart == 0, F.when(alike, "same").otherwise("relative")).when(apart == 1, F.when(alike, "adjacent").otherwise("near")).when(apart > 1, "clash")


def is_compatible(a: Column, b: Column) -> Column:
    return F.coalesce(key_compatibility(a, b).isin("same", "relative", "adjacent"), F.lit(False))


def camelot_display(key: Column) -> Column:
    """The code with its note name, as ``8A (Am)``; anything else unchanged."""
    number = camelot_number(key)
    major = F.pmod((number - 1 - 7) * 7, F.lit(12))  # seven fifths undo a fifth, modulo twelve
    tonic = F.pmod(major - F.when(camelot_minor(key), 3).otherwise(0), F.lit(12)).cast("int")
    name = F.element_at(F.array(*map(F.lit, NOTE_NAMES)), tonic + 1)
    exact = key.rlike(r"^([1-9]|1[0-2])[AB]$")
    return F.when(exact, F.concat(key, F.lit(" ("), name, F.when(camelot_minor(key), "m").otherwise(""), F.lit(")"))).otherwise(key)


def bpm_delta_pct(a: Column, b: Column) -> Column:
    """Distance of b from a in per cent of a, in the closest octave, to one decimal; 0 counts as missing."""
    ratio = lambda x: F.abs(x - a) / F.nullif(a, F.lit(0.0)) * 100
    return half_up(F.least(ratio(b), ratio(b * 2), ratio(b / 2)), 1)


def bpm_out_of_range(bpm: Column) -> Column:
    return ~bpm.between(BPM_LOW, BPM_HIGH)


def suggest_bpm(bpm: Column, genre: Column) -> Column:
    """The doubled tempo, where a dance genre makes a slow reading doubtful."""
    return F.when(genre.rlike(DANCE) & (bpm < 95) & (bpm * 2 <= BPM_HIGH), bpm * 2)


def bpm_suspect(bpm: Column, genre: Column) -> Column:
    return F.coalesce(bpm_out_of_range(bpm) | suggest_bpm(bpm, genre).isNotNull(), F.lit(False))


def tempo_key_vector(bpm: Column, key: Column, use_tempo: bool = True, use_key: bool = True) -> Column:
    """Six dimensions: log2 tempo, its octave fraction on a circle, and the key vector; missing parts are 0."""
    octave = F.pmod(F.log2(bpm), F.lit(1.0)) * (2 * math.pi)
    zero = F.lit(0.0)
    tempo = [F.coalesce(x, zero) if use_tempo else zero for x in (F.log2(bpm), F.sin(octave), F.cos(octave))]
    wheel = [F.coalesce(F.get(key_vector(key), i), zero) if use_key else zero for i in range(3)]
    return F.array(*tempo, *wheel)


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def genre_label(genre: Column) -> Column:
    """Outer white space gone, inner runs as one space; empty is null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(genre, SPACE_ENDS, ""), r"[\s\p{Z}]+", " "), F.lit(""))


def genre_key(genre: Column) -> Column:
    return F.lower(genre_label(genre))
