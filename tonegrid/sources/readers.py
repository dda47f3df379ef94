"""Readers of collection exports, lookup checkpoints and file inventories, with fixed schemas."""

from __future__ import annotations

import plistlib
import re
import xml.etree.ElementTree as ET
from datetime import datetime
from io import BytesIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.functions.music import half_up, to_camelot
from tonegrid.functions.text import canonical_label, clock_ms, day, decode_location, path_segments

# Columns of a text export, audio extensions, depth and number of listed files.
TEXT_COLUMNS = ("#", "Artwork", "Track Title", "Artist", "Album", "Genre", "BPM", "Rating", "Time", "Key", "Date Added")
AUDIO = ("mp3", "m4a", "aac", "wav", "aif", "aiff", "flac", "ogg", "oga", "opus", "alac", "wma")
MAX_DEPTH, MAX_FILES = 16, 200_000

_XML_TRACK = "_TrackID string, _Name string, _Artist string, _Album string, _Genre string, _Year string, _TotalTime string, _AverageBpm string, _Tonality string, _DateAdded string, _Location string, _Remixer string, _Label string"


def detect_format(name: Column, head: Column) -> Column:
    """text, xml or plist, from a file's name and first bytes as text."""
    return F.when(F.lower(name).endswith(".txt") | head.contains("\tTrack Title\t"), "text").when(head.contains("DJ_PLAYLISTS"), "xml").otherwise("plist")


def route(spark: SparkSession, path: str) -> DataFrame:
    """(path, format) of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.decode(F.substring("content", 1, 4096), "UTF-8")
    return files.select("path", detect_format(F.col("path"), head).alias("format"))


#: A tag from behind its ``<``: closing, name, attributes, empty.
_TAG = r"""(/?)([^\s/>"'=]+)((?:\s+[^\s=/>"']+\s*=\s*(?:"[^"]*"|'[^']*'))*)\s*(/?)>"""


def _xml_tags(spark: SparkSession, path: str) -> DataFrame | None:
    """(file, start, value): a row for each ``<`` of the documents, with what follows it up to the next, in order within a
    block of a file that begins at ``start``. No attribute holds a ``<``, so a document may be split at any.

    None where a comment or another section may hold markup, or the encoding is not a superset of ASCII in UTF-8.
    """
    tags = spark.read.option("lineSep", "<").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    v = F.col("value")
    encoding = F.lower(F.regexp_extract(v, r"""^\?xml[^>]*encoding\s*=\s*["']([^"']*)""", 1))
    odd = (v.startswith("!") & ~(v.startswith("!--") & v.contains("-->"))) | v.contains("\0") | ~encoding.isin("", "utf-8", "us-ascii")
    return tags if tags.where(odd).isEmpty() else None


def read_xml_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Tracks of XML exports; references in playlists carry a key and no name, and are left out.

    Tempo and key are the user's own analysis: confidence 1, source ``rekordbox``. ``path`` is the decoded location.
    Documents are split among tasks at their tags (``_xml_tags``); others are read whole by Spark's reader.
    """
    tags = _xml_tags(spark, path)
    if tags is None:
        rows = spark.read.format("xml").option("rowTag", "TRACK").schema(_XML_TRACK).load(path)
    else:
        attributes = F.regexp_extract("value", f"^{_TAG}", 3)
        named = tags.where(F.col("value").rlike(r"^TRACK\s") & F.col("value").contains("TrackID"))
        rows = named.select(F.from_xml(F.concat(F.lit("<TRACK"), attributes, F.lit("/>")), _XML_TRACK).alias("t")).select("t.*")
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    positive = lambda c, t: F.when(F.col(c).try_cast(t) > 0, F.col(c).try_cast(t))
    found = rows.where("_TrackID is not null and _Name is not null and _Name <> ''").select(
        F.col("_TrackID").try_cast("long").alias("track_id"), F.col("_Name").alias("name"), text("_Artist").alias("artist"), text("_Album").alias("album"), text("_Genre").alias("genre"),
        positive("_Year", "int").alias("year"), half_up(F.coalesce(positive("_TotalTime", "double"), F.lit(0.0)) * 1000).cast("long").alias("duration_ms"), positive("_AverageBpm", "double").alias("bpm"),
        to_camelot(F.col("_Tonality")).alias("key"), F.try_to_date("_DateAdded", "yyyy-MM-dd").alias("date_added"), text("_Location").alias("location"), decode_location(text("_Location")).alias("path"),
        canonical_label(text("_Label"), text("_Artist")).alias("label"), F.when(text("_Remixer").isNotNull(), F.array("_Remixer")).alias("tags"),
    )
    return _with_origin(found, ("bpm", "key", "label"), ("bpm", "key"), "rekordbox")


def _with_origin(tracks: DataFrame, fields: tuple[str, ...], sure: tuple[str, ...], source: str) -> DataFrame:
    """Where the fields came from, and full confidence in some of them."""
    origin = {f"source_{c}": F.when(F.col(c).isNotNull(), source) for c in fields}
    return tracks.withColumns(origin | {f"{c}_confidence": F.when(F.col(c).isNotNull(), 1.0) for c in sure})


def _documents(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """Rows that ``parse`` (bytes to dicts) finds in each document; a document is one row and so one task's work."""

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                yield pd.DataFrame([{"file": name, **r} for r in parse(content)], columns=names)

    names = [c.split()[0] for c in schema.split(", ")]
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_xml_playlists(spark: SparkSession, path: str) -> DataFrame:
    """(file, playlist, key_type, key, pos); folders prefix the names below them, the root does not count.

    Documents are split among tasks at their tags (``_xml_tags``): a first pass tells which elements each block of a file
    closes and leaves open, a row for each block; together they give the elements that are open where a block begins, from
    which the second pass reads on. Files named ``part-...`` in one folder (``sinks.write_xml``) follow each other in a document,
    whose file is the first. Documents that cannot be split are read whole, each by a task. What is not well formed is
    an error.
    """
    schema = "file string, playlist string, key_type int, key string, pos long"
    tags = _xml_tags(spark, path)
    if tags is None:
        return _documents(spark, path, _xml_lists, schema)
    begun = _open_elements(tags)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64()]

    def run(batches):
        at = walk = None
        for b in batches:
            out: list[tuple] = []
            for block, values in _blocks(b):
                if block != at:
                    at, walk = block, _Walk(*begun[block])
                out += ((walk.document, *found) for v in values if (found := walk.step(v)))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return tags.withColumn("value", F.col("value").cast("binary")).mapInArrow(run, schema)


def _xml_lists(content: bytes):
    """The lists of a document as a whole."""
    todo = [(n, ()) for n in ET.parse(BytesIO(content)).getroot().findall("./PLAYLISTS/NODE")]
    while todo:
        node, above = todo.pop(0)
        name = node.get("Name", "")
        if node.get("Type") == "0":
            inner = above if name == "ROOT" and not above else (*above, name)
            todo = [(n, inner) for n in node.findall("NODE")] + todo
            continue
        for pos, t in enumerate(node.findall("TRACK")):
            yield {"playlist": " / ".join((*above, name)), "key_type": int(node.get("KeyType") or 0), "key": t.get("Key"), "pos": pos}


_TAG_BYTES = re.compile(_TAG.encode())
_REFERENCE = re.compile(rb"""TRACK\s+Key="([^"&\r\n\t]*)"\s*/>""")  # the commonest tag
_ATTRIBUTE = re.compile(rb"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def _attribute(attributes: bytes, name: bytes) -> str | None:
    """The value of an attribute, as an XML parser gives it."""
    code = lambda m: _ENTITIES[m[1]] if m[1][0] != "#" else chr(int(m[1][2:], 16) if m[1][1] == "x" else int(m[1][1:]))
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1] == name:
            return re.sub(r"&([^;]+);", code, re.sub(r"\r\n|[\r\n\t]", " ", (m[2] if m[2] is not None else m[3]).decode()))
    return None


class _Walk:
    """The elements (tag, attributes, TRACK elements so far) that are open while the tags of a block go by. Where those of
    before the block are not known, ``closed`` has the tags of those that it closes, and ``more`` counts the TRACK elements
    of the innermost that is left."""

    def __init__(self, document: str | None = None, above: tuple = (), known: bool = True):
        self.document, self.known = document, known
        self.open = [list(e) for e in above]
        self.closed: list[bytes] = []
        self.more = 0
        self.playlist = self._named()

    def _named(self) -> tuple[str, int] | None:
        """(playlist, key_type) where the innermost element is a list."""
        e = self.open
        if not self.known or len(e) < 3 or e[1][0] != b"PLAYLISTS" or any(x[0] != b"NODE" for x in e[2:]):
            return None
        kinds = [_attribute(x[1], b"Type") for x in e[2:]]
        if kinds[-1] == "0" or any(k != "0" for k in kinds[:-1]):
            return None
        names = [_attribute(x[1], b"Name") or "" for x in e[2:]]
        above = names[:-1]
        while above and above[0] == "ROOT":
            above = above[1:]
        return " / ".join((*above, names[-1])), int(_attribute(e[-1][1], b"KeyType") or 0)

    def step(self, value: bytes) -> tuple[str, int, str | None, int] | None:
        """Goes on by a tag; a TRACK element of a list gives (playlist, key_type, key, pos)."""
        if m := _REFERENCE.match(value):
            if not self.open:
                self.more += 1
                return None
            top = self.open[-1]
            top[2] += 1
            return (*self.playlist, m[1].decode(), top[2] - 1) if self.playlist else None
        m = _TAG_BYTES.match(value)
        if m is None:
            if value[:1] in (b"?", b"!") or not value.strip(b"\xef\xbb\xbf \t\r\n"):
                return None
            raise ValueError(f"not well formed: <{value[:80].decode(errors='replace')}")
        closing, tag, attributes, empty = m.groups()
        if closing:
            if self.open:
                if self.open.pop()[0] != tag:
                    raise ValueError(f"not well formed: </{tag.decode()}>")
            elif self.known:
                raise ValueError(f"not well formed: </{tag.decode()}>")
            else:
                self.closed.append(tag)
                self.more = 0
            self.playlist = self._named()
            return None
        found = None
        if tag == b"TRACK":
            if self.playlist:
                found = (*self.playlist, _attribute(attributes, b"Key"), self.open[-1][2])
            if self.open:
                self.open[-1][2] += 1
            else:
                self.more += 1
        if not empty:
            self.open.append([tag, attributes if tag == b"NODE" else b"", 0])
            self.playlist = self._named()
        return found


def _blocks(batch: pa.RecordBatch):
    """((file, start), values) of each run of rows of one block."""
    n, values = batch.num_rows, batch["value"].to_pylist()
    at = lambda i: (batch["file"][i].as_py(), batch["start"][i].as_py())
    if n and at(0) == at(n - 1):  # blocks do not come twice
        yield at(0), values
        return
    starts, files, lo = batch["start"].to_pylist(), batch["file"].to_pylist(), 0
    for hi in range(1, len(values) + 1):
        if hi == len(values) or starts[hi] != starts[lo] or files[hi] != files[lo]:
            yield (files[lo], starts[lo]), values[lo:hi]
            lo = hi


def _open_elements(tags: DataFrame) -> dict[tuple[str, int], tuple[str, tuple]]:
    """(document, open elements) where each block (file, start) begins, from one row for each block."""
    element = pa.struct([("tag", pa.binary()), ("attributes", pa.binary()), ("n", pa.int64())])
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("closed", pa.list_(pa.binary())), ("more", pa.int64()), ("open", pa.list_(element))])

    def run(batches):
        at = walk = None
        told = lambda: pa.RecordBatch.from_pylist([{"file": at[0], "start": at[1], "closed": walk.closed, "more": walk.more, "open": [dict(zip(("tag", "attributes", "n"), e, strict=True)) for e in walk.open]}], schema)
        for b in batches:
            for block, values in _blocks(b):
                if block != at:
                    if at is not None:
                        yield told()
                    at, walk = block, _Walk(known=False)
                for v in values:
                    walk.step(v)
        if at is not None:
            yield told()

    ddl = "file string, start long, closed array<binary>, more long, open array<struct<tag: binary, attributes: binary, n: bigint>>"
    rows = tags.withColumn("value", F.col("value").cast("binary")).mapInArrow(run, ddl).collect()
    folder = lambda f: f.rsplit("/", 1)[0] if f.rsplit("/", 1)[1].startswith("part-") else f
    begun, above, document, last = {}, [], None, None
    for r in sorted(rows, key=lambda r: (folder(r.file), r.file, r.start)):
        if folder(r.file) != last and above:
            raise ValueError(f"{document} ends inside <{above[-1][0].decode()}>")
        last = folder(r.file)
        document = document if above else r.file
        begun[r.file, r.start] = (document, tuple(map(tuple, above)))
        for tag in r.closed:
            if not above or above[-1][0] != bytes(tag):
                raise ValueError(f"{document} is not well formed: </{bytes(tag).decode()}>")
            above.pop()
        if above:
            above[-1][2] += r.more
        above += [[bytes(e.tag), bytes(e.attributes), e.n] for e in r.open]
    if above:
        raise ValueError(f"{document} ends inside <{above[-1][0].decode()}>")
    return begun


def read_plist_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Tracks with a persistent id, a track id and a name; a tempo is the file's own, with confidence 1."""

    def parse(content: bytes):
        for t in plistlib.loads(content).get("Tracks", {}).values():
            if t.get("Persistent ID") and t.get("Track ID") and t.get("Name"):
                yield {"pid": t["Persistent ID"], "track_id": int(t["Track ID"]), "name": t["Name"], "artist": t.get("Artist"), "album": t.get("Album"), "genre": t.get("Genre"), "year": t.get("Year") or None, "duration_ms": int(t.get("Total Time", 0)), "bpm": float(t["BPM"]) if t.get("BPM") else None, "location": t.get("Location"), "date_added": t.get("Date Added") if isinstance(t.get("Date Added"), datetime) else None}

    found = _documents(spark, path, parse, "file string, pid string, track_id long, name string, artist string, album string, genre string, year double, duration_ms long, bpm double, location string, date_added timestamp").withColumn("year", F.col("year").cast("int"))
    return _with_origin(found, ("bpm",), ("bpm",), "file")


def read_plist_playlists(spark: SparkSession, path: str) -> DataFrame:
    """(file, playlist, list_pos, master, distinguished, smart, track_id, pos); an empty list is one row without track."""

    def parse(content: bytes):
        for n, p in enumerate(plistlib.loads(content).get("Playlists", [])):
            base = {"playlist": p.get("Name"), "list_pos": n, "master": bool(p.get("Master")), "distinguished": p.get("Distinguished Kind"), "smart": "Smart Info" in p}
            items = [i.get("Track ID") for i in p.get("Playlist Items", [])] or [None]
            yield from ({**base, "track_id": t, "pos": k} for k, t in enumerate(items))

    return _documents(spark, path, parse, "file string, playlist string, list_pos long, master boolean, distinguished double, smart boolean, track_id double, pos long").withColumn("track_id", F.col("track_id").cast("long")).withColumn("distinguished", F.col("distinguished").cast("long"))


def text_export_report(spark: SparkSession, path: str, encoding: str = "UTF-16") -> DataFrame:
    """(declared, parsed, skipped) rows of a text export; those without title are skipped."""
    titled = F.coalesce(F.trim("`Track Title`") != "", F.lit(False))
    return _text_rows(spark, path, encoding).agg(F.count("*").alias("declared"), F.count_if(titled).alias("parsed"), F.count_if(~titled).alias("skipped"))


def _text_rows(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", header=True, encoding=encoding, multiLine=True, quote="")
    if missing := set(TEXT_COLUMNS) - set(rows.columns):
        raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
    return rows


def read_text_export(spark: SparkSession, path: str, encoding: str = "UTF-16") -> DataFrame:
    """Rows of a text export, numbered; a missing column is an error, a row without title is left out."""
    rows = _text_rows(spark, path, encoding).withColumn("line", F.monotonically_increasing_id())
    text = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    return rows.where(text("Track Title").isNotNull()).select(
        "line", *(F.col(f"`{c}`") for c in TEXT_COLUMNS), text("Track Title").alias("name"), text("Artist").alias("by"), F.when(text("BPM").try_cast("double") > 0, text("BPM").try_cast("double")).alias("tempo"),
        to_camelot(text("Key")).alias("camelot"), clock_ms(text("Time")).alias("duration_ms"), day(text("Date Added")).alias("added"),
    )


#: Fields of the three catalogues' items; a field that an answer lacks is null.
_ITEM = (
    "array<struct<id: string, title: string, trackName: string, artist: struct<name: string>, artistName: string, album: struct<title: string>, tempo: string, bpm: string, "
    "key_of: string, open_key: string, release_date: string, preview: string, previewUrl: string, primaryGenreName: string, copyright: string, duration: string>>"
)


def parse_candidates(payloads: DataFrame, column: str = "body") -> DataFrame:
    """Candidates (payload columns, pos, catalogue_id, artist, title, album, bpm, key, year, duration_ms, preview_url, tags,
    copyright) of search answers of three catalogues: lists under ``search``, ``data`` or ``results``.

    An answer that is no list, an error say, has none; a tempo of 0 and a year up to 1900 are unknown.
    """
    body = F.coalesce(F.get_json_object(column, "$.search"), F.get_json_object(column, "$.data"), F.get_json_object(column, "$.results"))
    found = payloads.where(body.startswith("[")).withColumn("__c", F.from_json(body, _ITEM))
    rows = found.select(*payloads.columns, F.posexplode("__c").alias("pos", "c"))
    year = F.substring("c.release_date", 1, 4).try_cast("int")
    tempo = F.coalesce("c.tempo", "c.bpm").try_cast("double")
    text = lambda *c: F.nullif(F.coalesce(*c), F.lit(""))
    return rows.select(
        *[c for c in payloads.columns if c != column], "pos", F.col("c.id").alias("catalogue_id"), F.coalesce("c.artist.name", "c.artistName").alias("artist"), F.coalesce("c.title", "c.trackName").alias("title"),
        F.col("c.album.title").alias("album"), F.when(tempo > 0, tempo).alias("bpm"), F.coalesce(to_camelot(F.col("c.open_key")), to_camelot(F.col("c.key_of"))).alias("key"), F.when(year > 1900, year).alias("year"),
        (F.nullif(F.col("c.duration").try_cast("long"), F.lit(0)) * 1000).alias("duration_ms"), text("c.preview", "c.previewUrl").alias("preview_url"), F.when(text("c.primaryGenreName").isNotNull(), F.array("c.primaryGenreName")).alias("tags"), F.col("c.copyright").alias("copyright"),
    )


def read_checkpoints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Outcomes of lookup trials; of one pid in several files, the first in order."""
    schema = "seed long, results array<struct<pid: string, artist: string, title: string, status: string, via: string, matchedArtist: string, matchedTitle: string, rawTempo: double, keyOf: string, openKey: string>>"
    out = None
    for i, p in enumerate(paths):
        rows = spark.read.schema(schema).json(p, multiLine=True).select(F.lit(i).alias("source"), F.posexplode("results").alias("pos", "r")).select("source", "pos", "r.*")
        out = rows if out is None else out.unionByName(rows)
    from tonegrid.operators.library import keep_first

    return keep_first(out, ["pid"], F.col("source"), F.col("pos"))


def audio_files(files: DataFrame, limit: int = MAX_FILES) -> tuple[DataFrame, DataFrame]:
    """(kept, report) of files (file_id, path): audio by extension, not hidden, not too deep; at most ``limit``, and
    whether that cut any."""
    parts = path_segments(F.col("path"))
    name = F.element_at(parts, -1)
    extension = F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))
    good = files.where(extension.isin(*AUDIO) & (F.size(parts) - 1 <= MAX_DEPTH) & ~F.exists(parts, lambda s: s.startswith(".")))
    report = good.agg(F.least(F.count("*"), F.lit(limit)).alias("files"), (F.count("*") > limit).alias("truncated"))
    return good.orderBy("file_id").limit(limit), report


def seconds(duration_ms: Column) -> Column:
    return half_up(duration_ms / 1000).cast("long")
