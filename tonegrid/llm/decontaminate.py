"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of benchmark items; all patterns of one length form a search class. Per class, a shift
table over blocks of consecutive words says how far the search may jump when a block ends a window, blocks that end a
pattern select the patterns to test, and a comparison of the words themselves confirms each occurrence.

The tables are flat arrays over the benchmark's words, about eight bytes for each byte of text, broadcast in parts of at
most ``part_bytes`` of text. Further parts are searched one after another, each from a checkpoint of what is hit so far,
so that neither driver nor executors ever hold the tables of more than one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrid.llm._blocks import runs_of
from tonegrid.llm._tables import apart
from tonegrid.llm._vec import ALNUM, Words, covered, mix, passes, release, rows, utf8
from tonegrid.operators.lineage import cut

WINDOW = 13
#: Words of a block of the shift tables.
BLOCK = 3
#: Window ends that one search lane walks; the lanes of a pass advance together.
LANE = 512
PART_BYTES = 8_000_000

U = np.uint64
_BLOCK_ROOT, _SALT = U(0x8CB92BA72F3D8DD7), 0x165667B19E3779F9


class SearchClass:
    """Shift table and suffix buckets of windows of ``length`` words each, which start at ``starts`` in the items' words."""

    def __init__(self, length: int, text: Words, starts: np.ndarray):
        self.length, self.block = length, min(BLOCK, length)
        self.data, self.start, self.end, self.hash = text.data, text.start, text.end, text.hash
        self.owner = text.text[starts].astype(np.int32)
        # blocks by their last word: the window that ends there, or else the item's first one, gives the shift
        item = np.unique(self.owner)
        size = text.count[item] - self.block + 1
        last = _ranges(text.first[item] + self.block - 1, size)
        shift = np.maximum(np.repeat(text.first[item] + length - 1, size) - last, 0)
        blocks = _blocks(self.hash, last, self.block)
        order = np.lexsort((shift, blocks))
        keys = blocks[order]
        new = np.append(True, keys[1:] != keys[:-1])
        self.keys, self.shifts = keys[new], shift[order][new].astype(np.int32)
        # windows that repeat are one pattern, told apart by two hashes; the pattern's own words confirm a match
        one, two = text.grams(length)[starts], text.grams(length, salt=_SALT)[starts]
        order = np.lexsort((self.owner, two, one))
        head, _ = runs_of(one[order], two[order])
        suffix = _blocks(self.hash, starts[order[head]] + length - 1, self.block)
        by = np.argsort(suffix, kind="stable")
        self.suffix, self.first = suffix[by], starts[order[head]][by]
        tails = np.append(head[1:], len(order))
        self.owners = self.owner[order][_ranges(head[by], (tails - head)[by])]
        self.cuts = np.append(0, np.cumsum((tails - head)[by]))

    def search(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """Where windows start in the words of the texts, and which pattern is there."""
        long = np.flatnonzero(text.count >= self.length)
        if not len(long):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first_end, last_end = text.first[long] + self.length - 1, text.last[long]
        lanes = -(-(last_end - first_end) // LANE)
        lane = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(first_end, lanes) + lane * LANE
        stop = np.minimum(at + LANE, np.repeat(last_end, lanes))
        starts, found = [], []
        while len(at):
            blocks = _blocks(text.hash, at, self.block)
            slot = np.minimum(np.searchsorted(self.keys, blocks), len(self.keys) - 1)
            shift = np.where(self.keys[slot] == blocks, self.shifts[slot], self.length - self.block + 1)
            if len(here := np.flatnonzero(shift == 0)):
                s, p = self._test(text, at[here], blocks[here])
                starts.append(s)
                found.append(p)
            at = at + np.maximum(shift, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return (np.concatenate(starts), np.concatenate(found)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _test(self, text: Words, ends: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.searchsorted(self.suffix, blocks), np.searchsorted(self.suffix, blocks, "right")
        ends, pattern = np.repeat(ends, high - low), _ranges(low, high - low)
        for k in range(self.length):
            same = text.hash[ends - k] == self.hash[self.first[pattern] + self.length - 1 - k]
            ends, pattern = ends[same], pattern[same]
        starts, first, ok = ends - self.length + 1, self.first[pattern], np.ones(len(ends), bool)
        for k in range(self.length):
            places = zip(text.start[starts + k].tolist(), text.end[starts + k].tolist(), self.start[first + k].tolist(), self.end[first + k].tolist(), strict=True)
            ok &= np.fromiter((text.data[a:b].tobytes() == self.data[c:d].tobytes() for a, b, c, d in places), bool, len(ok))
        return starts[ok], pattern[ok]

    def items(self, pattern: int) -> list[int]:
        """The items that hold a pattern, by place in the list."""
        return self.owners[self.cuts[pattern] : self.cuts[pattern + 1]].tolist()


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after another."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def _blocks(hashes: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that end at each of ``ends``."""
    out = np.zeros(len(ends), U)
    for k in range(size - 1, -1, -1):
        out = out * _BLOCK_ROOT + hashes[ends - k]
    return mix(out)


def search_classes(items: list[bytes], window: int = WINDOW) -> list[SearchClass]:
    """The windows of the items by length."""
    text = Words(items, ALNUM, lower=True)
    text.start, text.end = text.start.astype(np.int32), text.end.astype(np.int32)
    lengths = np.minimum(text.count, window)
    out = []
    for length in sorted({*lengths.tolist()} - {0}):
        item = np.flatnonzero(lengths == length)
        out.append(SearchClass(length, text, _ranges(text.first[item], text.count[item] - length + 1)))
    return out


def _scan(batches, schema: pa.Schema, names: list[str], classes, carried: bool, last: bool):
    for batch in batches:
        texts = utf8(batch["text"])
        for low, high in passes(texts):
            text = Words(texts[low:high], ALNUM, lower=True)
            owner, held = text.text, [set() for _ in range(high - low)]
            hit = np.zeros(len(text.start), bool)
            if carried:
                for i, (places, items) in enumerate(zip(batch["hit_words"][low:high].to_pylist(), batch["hit_items"][low:high].to_pylist(), strict=True)):
                    hit[text.first[i] + np.frombuffer(places, np.uint32)] = True
                    held[i].update(items)
            for search in classes:
                starts, which = search.search(text)
                hit |= covered(starts, search.length, len(hit))
                for i, p in set(zip(owner[starts].tolist(), which.tolist(), strict=True)):
                    held[i].update(names[k] for k in search.items(p))
            per_text = np.add.reduceat(np.append(hit, False).astype(np.int64), text.first) * (text.count > 0) if len(text.count) else np.zeros(0, np.int64)
            part = batch.slice(low, high - low)
            if last:
                new = {
                    "n_words": text.count, "n_hit": per_text, "n_items": [len(x) for x in held],
                    "items_sha256": [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in held],
                    "contaminated": (per_text > 0) & (20 * per_text >= text.count),
                }
            else:
                new = {"hit_words": [np.flatnonzero(hit[a:b]).astype(np.uint32).tobytes() for a, b in zip(text.first, text.last, strict=True)], "hit_items": [sorted(x) for x in held]}
            yield rows(schema, **{f.name: part[f.name] for f in schema if f.name not in new}, **new)


_DIGEST = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())]


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The columns ``keep`` of ``docs`` (text: string) with what of each text occurs in ``benchmark`` (item_id, text).

    Adds n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256 and contaminated
    (n_hit > 0 and 20 * n_hit >= n_words). Null texts have no words. A null item_id counts as the id "null"; items
    with the same id are one item; an empty benchmark hits nothing. Rows are judged one by one, repeated rows too.
    Clashing names: the added columns win.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").where("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_parts = max(1, -(-total // part_bytes))
    docs, keep, back = apart(docs, [c for c in keep if c not in dict(_DIGEST)], ("hit_words", "hit_items"))
    docs = docs.select(*keep, *[c for c in ("text",) if c not in keep])
    fields = {f.name: f for f in docs.schema}
    ddl = lambda names: ", ".join(f"`{c}` {fields[c].dataType.simpleString()}" for c in names)
    out = docs.select(*dict.fromkeys([*keep, "text"]))
    for k in range(n_parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)) == k) if n_parts > 1 else items
        found = [(r[0], r[1].encode()) for r in part.collect()]  # at most about part_bytes
        tables = spark.sparkContext.broadcast((search_classes([x for _, x in found], window), [x for x, _ in found]))
        last = k == n_parts - 1
        names = keep if last else list(dict.fromkeys([*keep, "text"]))
        schema = ddl(names) + (", n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" if last else ", hit_words binary, hit_items array<string>")

        def run(batches, carried=k > 0, last=last, names=names, tables=tables):
            classes, ids = tables.value
            schema = None
            for batch in batches:
                if schema is None:
                    added = _DIGEST if last else [("hit_words", pa.binary()), ("hit_items", pa.list_(pa.string()))]
                    schema = pa.schema([*(batch.schema.field(c) for c in names), *(pa.field(*x) for x in added)])
                yield from _scan([batch], schema, ids, classes, carried, last)
            release()

        out = out.mapInArrow(run, schema)
        if not last:
            out = cut(out)
            tables.destroy()
    return out.withColumnsRenamed(back)
