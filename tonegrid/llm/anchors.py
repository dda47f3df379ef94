"""Substring dedup by difference-cover anchors.

A difference cover D modulo p holds, for every difference d, two elements that differ by d. If a sequence of w words
occurs at places i and j, then some shift s < p puts both i + s and j + s on cover positions of their documents. So
only the anchors there, of w - p + 1 words, are hashed and exchanged: any repeated window shares one of them. Windows
around an anchor that another document has too are then extended: their full hashes (128 bits of hash, kept to 96
within a bucket) find the smallest document of each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tonegrid.llm._blocks import ANSWER, ASK, BLOCK, BUCKET, asked, bucket_of, by_bucket, ddl, dealt, ids_and_texts, in_order, joined, packed, runs_of, seen_twice, told, unpacked
from tonegrid.llm._tables import apart
from tonegrid.llm._vec import NOT_SPACE, Words, covered, release

WINDOW = 13
#: Perfect difference covers: every difference modulo the period comes from two elements.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
_ROOT2, _SALT2 = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9

_CLAIM = pa.schema([(BUCKET, pa.int64()), (BLOCK, pa.int32()), ("h", pa.binary()), ("tail", pa.binary()), ("ids", pa.binary()), ("places", pa.binary())])


def _without(text: bytes, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without runs of words: each with the space behind it, or before it where no word follows."""
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    out, at = [], 0
    for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        low, high = (start[i], start[j]) if j < len(start) else (end[i - 1] if i else 0, end[j - 1])
        out.append(text[at:low])
        at = high
    return b"".join([*out, text[at:]])


class _Block:
    """The words and anchors of a block's documents."""

    def __init__(self, block: pa.Table, window: int, buckets: int):
        self.table = in_order(block)
        ids, texts = ids_and_texts(self.table)
        self.words = words = Words(texts, NOT_SPACE)
        self.window, self.buckets = window, buckets
        self.period = max(p for p in COVERS if p <= (window + 1) // 2)
        self.ids = np.repeat(ids, words.count)
        place = np.arange(len(words.start)) - np.repeat(words.first, words.count)
        size = window - self.period + 1
        on = np.isin(place % self.period, COVERS[self.period]) & words.room(size) & np.repeat(words.count >= window, words.count)
        self.anchors = np.flatnonzero(on)
        hashes = words.grams(size)[self.anchors]
        order = np.argsort(hashes, kind="stable")
        starts, run = runs_of(hashes[order])
        self.run = np.empty(len(order), np.int64)  # of each anchor, its distinct hash
        self.run[order] = run
        self.hashes = hashes[order][starts]
        ends = np.append(starts[1:], len(order))
        by = self.ids[self.anchors[order]]
        self.known = by[starts] != by[ends - 1] if len(starts) else np.zeros(0, bool)  # ids ascend: two documents here have it

    def windows(self, answers: pa.Table) -> np.ndarray:
        """Where windows start that hold an anchor which another document has."""
        shared = self.known | told(self.hashes, self.buckets, answers)
        near = np.zeros(len(self.words.start) + self.period, bool)
        near[self.anchors[shared[self.run]] + self.period - 1] = True
        back = covered(np.flatnonzero(near[::-1]), self.period, len(near))[::-1]  # the places up to period - 1 before
        return np.flatnonzero(back[self.period - 1 :][: len(self.words.start)] & self.words.room(self.window))


def drop_repeated_windows(docs: DataFrame, keep: list[str], window: int = WINDOW, digest: bool = False) -> DataFrame:
    """Removes each word covered by a window of ``window`` words that also starts in a document with a smaller doc_id.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; windows are judged on the input. Returns the columns ``keep`` of
    ``docs`` (doc_id: long, text: string) and n_words, n_removed, kept_sha256 (of the kept words joined by one space).
    Without ``digest``, text is what is left when each run of removed words goes with the space behind it (before it, at
    the end of a text), so lines stay lines; null stays null. A null doc_id is larger than any other; rows of one doc_id count as one document, each row judged.
    Clashing names: the added columns win.
    """
    added = {"n_words": "long", "n_removed": "long", "kept_sha256": "string"}
    docs, keep, back = apart(docs, [c for c in keep if c not in added], (BLOCK, BUCKET))
    columns = list(dict.fromkeys([*keep, "doc_id", "text"]))
    blocks, buckets = dealt(docs, columns)

    def ask(table: pa.Table) -> pa.Table:
        if not len(table):
            return ASK.empty_table()
        b = _Block(table, window, buckets)
        return asked(b.hashes, table[BLOCK][0].as_py(), buckets)

    def claim(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _CLAIM.empty_table()
        b = _Block(table, window, buckets)
        at = b.windows(answers)
        number = table[BLOCK][0].as_py()
        if not len(at):
            return _CLAIM.empty_table()
        h1, h2 = b.words.grams(window)[at], b.words.grams(window, _ROOT2, _SALT2)[at]
        order = np.lexsort((h2, h1))
        starts, run = runs_of(h1[order], h2[order])
        ids = b.ids[at[order]]
        first = ids == ids[starts][run]  # of the block's smallest document with this window
        later = np.sort(at[order[~first]]).astype(np.int32)
        rows = [(number % buckets, b"", b"", b"", later.tobytes())] if len(later) else []
        entry = np.sort(order[first])  # in text order, which packs well
        e1, e2, where = h1[entry], h2[entry], at[entry]
        by, ranges = by_bucket(bucket_of(e1 ^ e2, buckets))
        for k, lo, hi in ranges:
            i = by[lo:hi]
            rows.append((k, packed(e1[i], 8), packed(e2[i], 4), b.ids[where[i]].tobytes(), where[i].astype(np.int32).tobytes()))
        cols = list(zip(*rows, strict=True))
        release()
        return pa.table([cols[0], [number] * len(rows), *cols[1:]], schema=_CLAIM)

    def settle(table: pa.Table) -> pa.Table:
        passed = pa.compute.equal(pa.compute.binary_length(table["h"]), 0)
        out = [(b, p) for b, p in zip(*(table.filter(passed)[c].to_pylist() for c in (BLOCK, "places")), strict=True)]
        table = table.filter(pa.compute.invert(passed))
        if len(table):
            (h1, sizes), (h2, _), (ids, _), (places, _) = (joined(table[c]) for c in ("h", "tail", "ids", "places"))
            h1, h2, ids, places = unpacked(h1, 8), unpacked(h2, 4), np.frombuffer(ids, np.int64), np.frombuffer(places, np.int32)
            owner = np.repeat(np.arange(len(sizes)), sizes // 8)
            order = np.lexsort((h2, h1))
            starts, run = runs_of(h1[order], h2[order])
            least = np.minimum.reduceat(ids[order], starts)[run]
            gone = np.zeros(len(ids), bool)
            gone[order] = ids[order] > least
            number = table[BLOCK].to_pylist()
            hit = np.flatnonzero(gone)
            _, ranges = by_bucket(owner[hit])
            out += [(number[k], places[hit[lo:hi]].tobytes()) for k, lo, hi in ranges]
        release()
        return pa.table([[b for b, _ in out], [0] * len(out), [None] * len(out), [x for _, x in out]], schema=ANSWER)

    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = [c for c in keep if not (digest and c == "text")]

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = in_order(table)
        ids, texts = ids_and_texts(table)
        words = Words(texts, NOT_SPACE)
        starts = np.concatenate([np.frombuffer(x, np.int32) for x in answers["found"].to_pylist()] or [np.zeros(0, np.int32)])
        gone = covered(starts.astype(np.int64), window, len(words.start))
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first) * (words.count > 0) if len(texts) else np.zeros(0, np.int64)
        kept, left = [], {}
        for i, x in enumerate(texts):
            parts = x.split()
            if removed[i]:
                cover = gone[words.first[i] : words.last[i]]
                parts = [w for w, g in zip(parts, cover.tolist(), strict=True) if not g]
                if "text" in names:
                    at = slice(words.first[i], words.last[i])
                    left[i] = _without(x, words.start[at] - words.text_start[i], words.end[at] - words.text_start[i], cover).decode()
            kept.append(b" ".join(parts))
        new = {"n_words": words.count, "n_removed": removed, "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
        if "text" in names:
            new["text"] = [left.get(i, x) for i, x in enumerate(table["text"].to_pylist())]
        release()
        return pa.table({c: pa.array(new[c], table.schema.field(c).type) if c in new else table[c] for c in names} | {c: pa.array(new[c]) for c in added})

    asking = blocks.groupBy(BLOCK).applyInArrow(ask, ddl(ASK))
    answers = asking.groupBy(BUCKET).applyInArrow(seen_twice, ddl(ANSWER))
    claims = blocks.groupBy(BLOCK).cogroup(answers.groupBy(BLOCK)).applyInArrow(claim, ddl(_CLAIM))
    settled = claims.groupBy(BUCKET).applyInArrow(settle, ddl(ANSWER))
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in names), *(f"{c} {t}" for c, t in added.items())])
    return blocks.groupBy(BLOCK).cogroup(settled.groupBy(BLOCK)).applyInArrow(finish, schema).withColumnsRenamed(back)
