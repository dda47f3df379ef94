"""Text functions: normal forms for matching, labels, paths and links. What needs Unicode normal forms runs in Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of edition noise, credits, separators of artists, distributors that are no label, company forms.
EDITION = (
    r"remaster(?:ed)?(?:\s*\d{4})?", r"radio\s+edit", r"extended(?:\s+mix)?", r"original\s+mix", r"club\s+mix", r"dub\s+mix",
    r"(?:\w+\s+)?remix", r"(?:\w+\s+)?edit", r"(?:\w+\s+)?version", r"(?:\w+\s+)?mix", "instrumental", "acoustic", "live",
    "mono", "stereo", "deluxe", "single", r"bonus\s+track", "explicit", "clean",
)
CREDIT_IN_BRACKETS = r"\bfe?a?t\.?\b|\bfeaturing\b"
CREDIT = r"[\s,]*\b(?:feat\.?|ft\.?|featuring)\b.*$"
ARTIST_SEPARATOR = r"\s*(?:,|&|\bx\b|\bvs\.?\b|\band\b)\s*"
QUOTES = "\"'’`´"
NO_LABELS = (
    r"(?:www\.)?bpmsupreme\.com", "bpm supreme", "dj ?city", "beatport", "distrokid", "the orchard", "believe(?: digital)?", "awal",
    "tunecore", "ingrooves", "symphonic(?: distribution)?", "independent label", "not on label", r"\[?no label\]?",
)
COMPANY = r"(?:ltd\.?|limited|llc|inc\.?)"
LABEL_WORDS = r"(?:records?|recordings?|music|productions?|ltd|limited|llc|inc)"
KEY_WORDS = r"(?:records?|recordings?|music|ltd|limited|llc|inc)"

_A = re.ASCII | re.IGNORECASE
# \w and \b are ASCII here, white space is not.
_BLANK = " \t\n\r\f\v\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_rx = lambda pattern, flags=_A: re.compile(pattern.replace(r"[\s", "[" + _BLANK).replace(r"\s", f"[{_BLANK}]"), flags)
_edition = _rx(rf"\b(?:{'|'.join(EDITION)})\b")
_bracket = _rx(r"\s*[([{]([^()[\]{}]*)[)\]}]\s*$")
_in_bracket = _rx(CREDIT_IN_BRACKETS)
_dash = _rx(r"\s+[-–—]\s+([^-–—]+)$")
_credit = _rx(CREDIT, _A | re.DOTALL)
_separator = _rx(ARTIST_SEPARATOR)
_blanks = _rx(r"\s+")
_marks = re.compile("[\u0300-\u036f]")
_denied = [re.compile(f"^{p}$", _A) for p in NO_LABELS]
_company = re.compile(f"^{COMPANY}$", _A)
_company_end = _rx(rf"(?:,\s*)?{COMPANY}$")
_label_words = re.compile(rf"\b{LABEL_WORDS}\b", re.ASCII)
_key_words = re.compile(rf"\b{KEY_WORDS}\b\.?$", re.ASCII)


def _trim(s: str) -> str:
    return _blanks.sub(" ", s).strip(" ")


def _plain(s: str) -> str:
    """No accents, lower case."""
    return _marks.sub("", unicodedata.normalize("NFKD", s)).lower()


def _unquoted(s: str, quotes: str) -> str:
    return _trim(s.translate({ord(c): None for c in quotes}))


def title_form(title: str) -> str:
    """A title without trailing edition notes and credits; never empty unless the title is."""
    s = title
    while (m := _bracket.search(s)) and (_edition.search(m[1]) or _in_bracket.search(m[1])):
        s = s[: m.start()]
    if (m := _dash.search(s)) and _edition.search(m[1]):
        s = s[: m.start()]
    return _unquoted(_plain(_credit.sub("", s)), QUOTES) or _trim(_plain(title))


def artist_form(artist: str) -> str:
    """The first artist of a credit."""
    s = _credit.sub("", artist)
    first = _separator.split(s)[0]
    return _unquoted(_plain(first if _trim(first) else s), QUOTES) or _trim(_plain(artist))


def search_form(s: str) -> str:
    return _unquoted(_plain(s), QUOTES)


def label_form(raw: str | None, artist: str | None) -> str | None:
    """The last part of a label that is neither a distributor, a company form, nor the artist's own name."""
    parts = []
    for part in re.split(r"[,/()]+", raw or ""):
        part = _trim(part.strip("".join(c for c in " \t\n\r\f\v ()[]")))
        if not part or _company.match(part) or any(p.match(part) for p in _denied):
            continue
        if artist:
            label, act = _trim(_label_words.sub(" ", artist_form(part))), artist_form(artist)
            if label and act and (label in act or act in label):
                continue
        parts.append(part)
    return (_company_end.sub("", parts[-1]).strip() or None) if parts else None


def label_identity(label: str) -> str | None:
    """Spelling variants of one label fold to the same identity."""
    s = _key_words.sub("", unicodedata.normalize("NFKC", label).lower().replace("&", " and "))
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in s).split()) or None


#: Texts that are worth a step of arrays for one unit.
FEW_TEXTS = 16
# The seeds and factors of both halves of the hash.
HASH_SEEDS, HASH_FACTORS = (0x811C9DC5, 0x01000193), (0x01000193, 0x85EBCA6B)


def hash64(s: str) -> str:
    """Sixteen hex digits of two 32-bit multiplicative hashes over UTF-16 units."""
    return hashes64([s])[0]


def hashes64(texts: list[str]) -> list[str]:
    """``hash64`` of every text: all texts that are long enough take their next unit at once, longest first."""
    units = [np.frombuffer(s.encode("utf-16-le", "surrogatepass"), "<u2") for s in texts]
    sizes = np.array([len(u) for u in units], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat = np.concatenate([np.zeros(0, np.uint64), *(units[i].astype(np.uint64) for i in order)])
    starts, sizes = np.concatenate([[0], np.cumsum(sizes[order])[:-1]]).astype(np.int64), sizes[order]
    seeds, factors = (np.array(v, np.uint64)[:, None] for v in (HASH_SEEDS, HASH_FACTORS))
    state, mask = np.repeat(seeds, len(texts), axis=1), np.uint64(0xFFFFFFFF)
    live, at = len(texts), 0
    while live and (live := int(np.searchsorted(-sizes[:live], -at))) >= FEW_TEXTS:  # those with more than ``at`` units
        state[:, :live] = ((state[:, :live] ^ flat[starts[:live] + at]) * factors) & mask
        at += 1
    for i in range(live):  # the few longest, one by one
        x, y = map(int, state[:, i])
        for unit in flat[starts[i] + at : starts[i] + sizes[i]].tolist():
            x, y = ((x ^ unit) * HASH_FACTORS[0]) & 0xFFFFFFFF, ((y ^ unit) * HASH_FACTORS[1]) & 0xFFFFFFFF
        state[:, i] = x, y
    out = [""] * len(texts)
    for i, x, y in zip(order.tolist(), *state.tolist(), strict=True):
        out[i] = f"{x:08x}{y:08x}"
    return out


def _over(function):
    """A pandas UDF that asks the function once for each distinct string of a batch."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known = {x: function(x) for x in s.dropna().unique()}
        return s.map(known).astype(object).where(s.notna(), None)

    return run


def normalize_title(title: Column) -> Column:
    return _over(title_form)(title)


def normalize_artist(artist: Column) -> Column:
    return _over(artist_form)(artist)


def fold_for_search(text: Column) -> Column:
    return _over(search_form)(text)


def label_key(label: Column) -> Column:
    return _over(label_identity)(label)


def hash_64(text: Column) -> Column:
    """``hash64`` of a column, a batch at once; null for null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known = s.notna().to_numpy()
        out = np.full(len(s), None, dtype=object)
        out[known] = hashes64(s[known].tolist())
        return pd.Series(out)

    return run(text)


def fold_segment(segment: Column) -> Column:
    """NFC and lower case."""
    return _over(lambda s: unicodedata.normalize("NFC", s).lower())(segment)


def canonical_label(raw: Column, artist: Column) -> Column:
    @F.pandas_udf("string")
    def run(r: pd.Series, a: pd.Series) -> pd.Series:
        pairs = [(x, y if isinstance(y, str) else None) for x, y in zip(r, a, strict=True)]
        known = {p: label_form(*p) if isinstance(p[0], str) else None for p in set(pairs)}
        return pd.Series([known[p] for p in pairs], dtype=object)

    return run(raw, artist)


def lookup_key(artist: Column, title: Column) -> Column:
    return F.concat_ws("|", F.coalesce(normalize_artist(artist), F.lit("")), normalize_title(title))


def artist_key(artist: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(artist, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), F.lit(""))


def copyright_owner(text: Column) -> Column:
    """The owner of a copyright line: no sign, no year, nothing from an exclusive licence on."""
    s = F.regexp_replace(text, r"^[℗©]\s*(?:\d{4}\s*)?", "")
    return F.trim(F.get(F.split(s, r"(?i)\s+under exclusive licen[cs]e to\s+"), 0))


def label_of_copyright(line: Column, artist: Column) -> Column:
    """The label that a copyright line names, in its canonical form."""
    return canonical_label(copyright_owner(line), artist)


def decode_location(location: Column) -> Column:
    """The path of a file URL; a malformed one stays as it is."""
    path = F.regexp_replace(location, r"(?i)^file://(?:localhost)?", "")
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, r"[/\\]+"), lambda s: s != "")


def file_name_key(path: Column) -> Column:
    return F.lower(F.element_at(path_segments(path), -1))


def preview_expiry_ms(url: Column) -> Column:
    """When a signed link ends, in milliseconds; null if it does not."""
    return F.nullif(F.regexp_extract(url, r"exp=(\d+)", 1), F.lit("")).try_cast("long") * 1000


def preview_usable(url: Column, now_ms: Column) -> Column:
    """No end, or one over a minute away."""
    return url.isNotNull() & F.coalesce(preview_expiry_ms(url) - now_ms > 60_000, F.lit(True))


def search_url(*parts: Column, base: str = "https://www.beatport.com/search?q=") -> Column:
    """A store's search link for the parts that are not blank."""
    words = F.concat_ws(" ", *(F.nullif(F.trim(p), F.lit("")) for p in parts))
    return F.concat(F.lit(base), F.replace(F.url_encode(words), F.lit("+"), F.lit("%20")))


def clock_ms(text: Column) -> Column:
    """Milliseconds of mm:ss or hh:mm:ss; null if it is neither."""
    parts = F.transform(F.split(text, ":"), lambda x: x.try_cast("long"))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 60 + x)
    return F.when(F.size(parts).isin(2, 3), total * 1000)


def day(text: Column) -> Column:
    return F.try_to_date(text, "yyyy-MM-dd")
