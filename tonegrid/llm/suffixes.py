"""Suffix-array dedup: longest-previous-factor arrays over the text that can repeat.

Where a string of ``length`` bytes starts (a window), its smallest 16-byte hash elects an anchor; windows with the same
bytes elect the same anchor at the same offset. Consecutive windows with one anchor form a run, and the bytes that a
run's windows cover are its segment. Blocks of documents exchange the hashes of anchors and segments:

* a segment that occurs twice repeats as a whole, and needs no more work than that;
* of different segments with one anchor, one copy each meets in a suffix array, without the stretches whose windows
  are alone by their hash: suffixes sorted to ``length`` bytes, the longest common prefixes of neighbours, and previous
  and next smaller positions give each window's longest previous factor, so what is found earlier is found once;
* an anchor with more than ``HOT`` different segments has its windows compared by 128-bit hashes instead, spread over
  all tasks, each distinct window once per block: the exact way for groups too large for one suffix array.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tonegrid.llm._blocks import BLOCK, BUCKET, bucket_of, by_bucket, dealt, ids_and_texts, in_order, joined, runs_of
from tonegrid.llm._tables import apart
from tonegrid.llm._vec import flatten, range_hashes, seed_hashes, window_hashes

LENGTH = 400
#: Bytes of the strings whose hashes elect anchors.
SEED_BYTES = 16
#: Different segments of one anchor that may share a suffix array, and bytes of one array.
HOT, ARRAY_BYTES = 512, 1_500_000
_SALT2 = 0xC2B2AE3D27D4EB4F
DUP, LEAST, SHIP, SPREAD = 1, 2, 4, 8

_KINDS = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
_ASK = pa.schema([(BUCKET, pa.int64()), (BLOCK, pa.int32()), *((c, pa.binary()) for c in ("a", "h1", "h2", "ids", "places", "twice"))])
_ANSWER = pa.schema([(BLOCK, pa.int32()), (BUCKET, pa.int64()), ("codes", pa.binary())])
_SHIP = pa.schema([(BUCKET, pa.int64()), (BLOCK, pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("a", "h2", "ids", "places", "sizes", "data"))])
_FOUND = pa.schema([(BLOCK, pa.int32()), ("places", pa.binary()), ("sizes", pa.binary())])
KNOWN, SEGMENTS, WINDOWS = 0, 1, 2


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_KINDS[f.type]}" for f in schema)


def suffix_order(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts`` (at least ``depth`` bytes each) sorted to ``depth`` bytes, ties by place in ``starts``;
    and the longest common prefix, up to ``depth``, of each with the one before it."""
    n = len(data)
    step = 8
    padded = np.append(data, np.zeros(step, np.uint8)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(step):
        key = key << np.uint64(8) | padded[k : k + n]
    bits = np.uint64(max(1, n).bit_length())
    ranks: list[tuple[int, np.ndarray]] = []
    while True:
        order = np.argsort(key)
        first, run = runs_of(key[order])
        rank = np.empty(n, np.uint64)
        rank[order] = run.astype(np.uint64)
        ranks.append((step, rank))
        if step >= depth:
            break
        parts = [0, step, 2 * step] if 3 * bits <= 64 and 3 * step <= depth else [0, min(step, depth - step)]
        key = np.zeros(n, np.uint64)
        for offset in parts:
            key = key << bits
            key[: n - offset] |= rank[offset:]
        step = parts[-1] + step
    top = ranks[-1][1][starts]
    order = np.argsort(top, kind="stable")
    here, before = starts[order][1:], starts[order][:-1]
    lcp = np.zeros(len(order), np.int64)
    length = np.zeros(len(here), np.int64)
    for size, rank in reversed(ranks):
        for _ in range(2):
            go = np.flatnonzero(length + size <= depth)
            go = go[rank[here[go] + length[go]] == rank[before[go] + length[go]]]
            length[go] += size
    for _ in range(7):
        go = np.flatnonzero(length < depth)
        go = go[data[here[go] + length[go]] == data[before[go] + length[go]]]
        length[go] += 1
    lcp[1:] = length
    return order, lcp


def longest_previous(order: np.ndarray, lcp: np.ndarray, at_least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, by place: the length of its longest match with an earlier place, and that place (-1: none).

    The match is with the previous or the next smaller place in suffix order. Lengths below ``at_least`` are not
    followed further and come as 0.
    """
    n = len(order)
    length, source = np.zeros(n, np.int64), np.full(n, -1)
    for forward in (False, True):
        to = np.arange(n) + (1 if forward else -1)
        common = np.append(lcp[1:], 0) if forward else lcp.copy()
        live = np.flatnonzero((to >= 0) & (to < n) & (common >= at_least))
        while len(live):
            later = live[order[to[live]] > order[live]]  # not a smaller place: follow that one's own pointer
            nxt, low = to[to[later]], np.minimum(common[later], common[to[later]])
            to[later], common[later] = nxt, low
            live = later[(nxt >= 0) & (nxt < n) & (low >= at_least)]
        ok = np.flatnonzero((to >= 0) & (to < n) & (common >= at_least))
        ok = ok[order[to[ok]] < order[ok]]
        ok = ok[common[ok] > length[order[ok]]]
        length[order[ok]], source[order[ok]] = common[ok], order[to[ok]]
    return length, source


def _spans(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places as runs of consecutive ones."""
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(np.diff(places) > 1) + 1
    starts, ends = np.append(0, cut), np.append(cut, len(places))
    return places[starts], ends - starts


def _fill(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the runs."""
    total = int(sizes.sum())
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


def _repeating(data: np.ndarray, begin: np.ndarray, runs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The stretches of segments whose windows have a hash that another window has: segment, begin, windows, and how far
    into the segment. No other window can match, so the suffix arrays need no more than these."""
    starts, segment = _fill(begin, runs.astype(np.int64)), np.repeat(np.arange(len(runs)), runs)
    hashes = window_hashes(data, starts, length)
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(segment[at]) > 0)) + 1
    first, last = (np.append(0, cut), np.append(cut, len(at))) if len(at) else (at, at)
    some = segment[at[first]]
    return some, starts[at[first]], last - first, (starts[at[first]] - begin[some]).astype(np.int32)


class _Block:
    """A block's runs, and their distinct segments."""

    def __init__(self, block: pa.Table, length: int, buckets: int):
        ids, texts = ids_and_texts(in_order(block))
        self.data, start, end = flatten(texts)
        n, span = len(self.data), length - SEED_BYTES + 1
        windows = _fill(start, np.maximum(end - start - length + 1, 0))
        if not len(windows):
            self.starts = np.zeros(0, np.int64)
            return
        seeds = seed_hashes(self.data)
        at = np.arange(len(seeds))
        bits = np.uint64(max(24, n.bit_length()))
        low = (seeds >> bits << bits) | at.astype(np.uint64)
        reach = 1
        while 2 * reach <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
        owner = (low[windows] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        cut = np.flatnonzero((np.diff(owner) != 0) | (np.diff(windows) != 1)) + 1
        first, last = np.append(0, cut), np.append(cut, len(windows))
        self.starts, self.sizes = windows[first], last - first
        self.a = seeds[owner[first]]
        ends = self.starts + self.sizes - 1 + length
        self.h1, self.h2 = range_hashes(self.data, self.starts, ends), range_hashes(self.data, self.starts, ends, _SALT2)
        self.ids = ids[np.searchsorted(start, self.starts, "right") - 1]
        order = np.lexsort((self.h2, self.h1, self.a))  # stable, so each distinct segment's first copy comes first
        head, run = runs_of(self.a[order], self.h1[order], self.h2[order])
        self.head = order[head]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = run
        self.twice = np.diff(np.append(head, len(order))) > 1
        self.order, ranges = by_bucket(bucket_of(self.a[self.head], buckets))
        self.ranges = {b: (lo, hi) for b, lo, hi in ranges}


def mark_repeats(docs: DataFrame, keep: list[str], length: int = LENGTH, keep_first: bool = True, digest: bool = False) -> DataFrame:
    """Removes bytes of the UTF-8 texts covered by a string of ``length`` bytes that also starts elsewhere.

    With ``keep_first``, the first place of each such string (by doc_id, then place) stays and only later copies go;
    else every copy goes. Matches never cross documents and are judged on the input; overlaps count. Returns the
    columns ``keep`` of ``docs`` (doc_id: long, text: string) and n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256, and kept (binary: the remaining bytes) unless ``digest``. A null text is empty; a null doc_id comes
    last; rows that repeat are copies of each other, and rows of one doc_id are in an order of their own. Clashing names: the added columns win.
    """
    added = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"} | ({} if digest else {"kept": "binary"})
    docs, keep, back = apart(docs, [c for c in keep if c not in added], (BLOCK, BUCKET))
    blocks, buckets = dealt(docs, list(dict.fromkeys([*keep, "doc_id", "text"])))

    def ask(table: pa.Table) -> pa.Table:
        b = _Block(table, length, buckets)
        if not len(b.starts):
            return _ASK.empty_table()
        rows = []
        for k, (lo, hi) in b.ranges.items():
            g = b.order[lo:hi]
            i = b.head[g]
            rows.append((k, b.a[i].tobytes(), b.h1[i].tobytes(), b.h2[i].tobytes(), b.ids[i].tobytes(), b.starts[i].astype(np.int32).tobytes(), b.twice[g].tobytes()))
        cols = list(zip(*rows, strict=True))
        return pa.table([cols[0], [table[BLOCK][0].as_py()] * len(rows), *cols[1:]], schema=_ASK)

    def answer(table: pa.Table) -> pa.Table:
        get = lambda c, kind: np.frombuffer(joined(table[c])[0], kind)
        a, h1, h2, ids, places, twice = get("a", "u8"), get("h1", "u8"), get("h2", "u8"), get("ids", "i8"), get("places", "i4"), get("twice", bool)
        cuts = np.cumsum(joined(table["a"])[1] // 8)
        owner = np.repeat(table[BLOCK].to_numpy(), np.diff(np.append(0, cuts)))
        order = np.lexsort((places, owner, ids, h2, h1, a))
        segment, of_segment = runs_of(a[order], h1[order], h2[order])
        group, of_group = runs_of(a[order][segment])
        different = np.diff(np.append(group, len(segment)))[of_group]  # segments of the anchor, for each segment
        copies = np.diff(np.append(segment, len(order)))
        code = np.where(copies > 1, DUP, 0)[of_segment]
        code[segment] |= LEAST | np.where(different > HOT, SPREAD, np.where(different > 1, SHIP, 0))
        codes = np.empty(len(code), np.uint8)
        codes[order] = code
        out = [(b, codes[lo:hi].tobytes()) for b, lo, hi in zip(table[BLOCK].to_pylist(), [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True) if (codes[lo:hi] != LEAST).any()]
        return pa.table([[b for b, _ in out], [table[BUCKET][0].as_py()] * len(out), [c for _, c in out]], schema=_ANSWER)

    def ship(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _SHIP.empty_table()
        b = _Block(table, length, buckets)
        if not len(b.starts):
            return _SHIP.empty_table()
        number = table[BLOCK][0].as_py()
        code = np.full(len(b.head), LEAST, np.uint8)
        for bucket, codes in zip(answers[BUCKET].to_pylist(), answers["codes"].to_pylist(), strict=True):
            lo, hi = b.ranges[bucket]
            code[b.order[lo:hi]] = np.frombuffer(codes, np.uint8)
        known = b.twice[b.group] | (code[b.group] & DUP > 0)
        if keep_first:
            least = np.zeros(len(b.starts), bool)
            least[b.head[code & LEAST > 0]] = True
            known &= ~least
        rows = []

        def tell(places: np.ndarray) -> None:
            s, n = _spans(places)
            if len(s):
                rows.append((number % buckets, KNOWN, b"", b"", b"", s.astype(np.int32).tobytes(), n.astype(np.int32).tobytes(), b""))

        tell(_fill(b.starts[known], b.sizes[known]))
        group = np.flatnonzero(code & SHIP)
        by, ranges = by_bucket(bucket_of(b.a[b.head[group]], buckets))
        for k, lo, hi in ranges:
            i = b.head[group[by[lo:hi]]]
            s, n = b.starts[i], b.sizes[i]
            data = b"".join(b.data[x : x + y].tobytes() for x, y in zip(s.tolist(), (n + length - 1).tolist(), strict=True))
            rows.append((k, SEGMENTS, b.a[i].tobytes(), b"", b.ids[i].tobytes(), s.astype(np.int32).tobytes(), n.astype(np.int32).tobytes(), data))
        i = np.sort(b.head[code & SPREAD > 0])
        if len(i):
            w, width = _fill(b.starts[i], b.sizes[i]), b.sizes[i] + length - 1
            own, at = b.data[_fill(b.starts[i], width)], _fill(np.cumsum(width) - width, b.sizes[i])
            h1, h2, ids = window_hashes(own, at, length), window_hashes(own, at, length, _SALT2), np.repeat(b.ids[i], b.sizes[i])
            order = np.lexsort((h2, h1))
            head, run = runs_of(h1[order], h2[order])
            many = np.diff(np.append(head, len(order))) > 1
            again = many[run]
            if keep_first:
                again[head] = False
            tell(np.sort(w[order[again]]))
            e = order[head]
            by, ranges = by_bucket(bucket_of(h1[e] ^ h2[e], buckets))
            for k, lo, hi in ranges:
                j = e[by[lo:hi]]
                rows.append((k, WINDOWS, h1[j].tobytes(), h2[j].tobytes(), ids[j].tobytes(), w[j].astype(np.int32).tobytes(), b"", b""))
        if not rows:
            return _SHIP.empty_table()
        cols = list(zip(*rows, strict=True))
        return pa.table([cols[0], [number] * len(rows), *cols[1:]], schema=_SHIP)

    def match(table: pa.Table) -> pa.Table:
        part = lambda kind: table.filter(pc.equal(table["kind"], kind))
        known = part(KNOWN)
        out = [known.select(_FOUND.names)]

        def tell(owner: np.ndarray, places: np.ndarray) -> None:
            order = np.lexsort((places, owner))
            owner, places = owner[order], places[order].astype(np.int64)
            cut, _ = runs_of(owner) if len(owner) else (np.zeros(0, np.int64), None)
            found = []
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(owner)], strict=False):
                s, n = _spans(places[lo:hi])
                found.append((int(owner[lo]), s.astype(np.int32).tobytes(), n.astype(np.int32).tobytes()))
            if found:
                out.append(pa.table(list(zip(*found, strict=True)), schema=_FOUND))

        w = part(WINDOWS)
        if len(w):
            h1, sizes = joined(w["a"])
            h1, h2, ids, places = np.frombuffer(h1, "u8"), *(np.frombuffer(joined(w[c])[0], k) for c, k in (("h2", "u8"), ("ids", "i8"), ("places", "i4")))
            owner = np.repeat(w[BLOCK].to_numpy(), sizes // 8)
            order = np.lexsort((places, owner, ids, h2, h1))
            head, run = runs_of(h1[order], h2[order])
            again = (np.diff(np.append(head, len(order))) > 1)[run]
            if keep_first:
                again[head] = False
            tell(owner[order[again]], places[order[again]])
        s = part(SEGMENTS)
        if len(s):
            a, sizes = joined(s["a"])
            a, ids, places, runs = np.frombuffer(a, "u8"), *(np.frombuffer(joined(s[c])[0], k) for c, k in (("ids", "i8"), ("places", "i4"), ("sizes", "i4")))
            owner = np.repeat(s[BLOCK].to_numpy(), sizes // 8)
            data = np.frombuffer(joined(s["data"])[0], np.uint8)
            width = runs.astype(np.int64) + length - 1
            begin = np.cumsum(width) - width
            some, begin, runs, ahead = _repeating(data, begin, runs, length)
            a, ids, places, owner, width = a[some], ids[some], places[some] + ahead, owner[some], runs + length - 1
            order = np.argsort(a, kind="stable")
            head, _ = runs_of(a[order]) if len(order) else (np.zeros(0, np.int64), None)
            tails = np.append(head[1:], len(order))
            held = np.append(0, np.cumsum(width[order]))
            lo = 0
            while lo < len(order):  # as many anchors as fit in an array; one anchor has HOT segments at most
                group = np.searchsorted(head, lo)
                hi = int(tails[max(group, np.searchsorted(held[tails], held[lo] + ARRAY_BYTES, "right") - 1)])
                i = order[lo:hi]
                i = i[np.lexsort((places[i], owner[i], ids[i]))]  # so that places in the array ascend as in the corpus
                text = data[_fill(begin[i], width[i])]
                at = np.cumsum(width[i]) - width[i]
                starts = _fill(at, runs[i].astype(np.int64))
                sorted_, lcp = suffix_order(text, starts, length)
                longest, source = longest_previous(sorted_, lcp, length)
                hit = longest >= length
                if not keep_first:
                    hit[source[hit]] = True
                which = np.repeat(np.arange(len(i)), runs[i])
                hit = np.flatnonzero(hit)
                tell(owner[i[which[hit]]], places[i[which[hit]]] + starts[hit] - at[which[hit]])
                lo = hi
        return pa.concat_tables([x.cast(_FOUND) for x in out])

    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = [c for c in keep if not (digest and c == "text")]

    def finish(table: pa.Table, found: pa.Table) -> pa.Table:
        table = in_order(table)
        _, texts = ids_and_texts(table)
        data, start, end = flatten(texts)
        step = np.zeros(len(data) + 1, np.int64)
        for places, sizes in zip(found["places"].to_pylist(), found["sizes"].to_pylist(), strict=True):
            s, n = np.frombuffer(places, np.int32).astype(np.int64), np.frombuffer(sizes, np.int32)
            np.add.at(step, s, 1)
            np.add.at(step, s + n - 1 + length, -1)
        gone = np.cumsum(step)[:-1] > 0
        edge = np.diff(gone.astype(np.int8), prepend=0) == 1
        count = lambda mask: np.diff(np.append(0, np.cumsum(mask))[np.append(start, len(data))]) if len(texts) else np.zeros(0, np.int64)
        removed = count(gone)
        kept = [x if not n else data[s:e][~gone[s:e]].tobytes() for x, n, s, e in zip(texts, removed, start, end, strict=True)]
        new = {"n_bytes": end - start, "n_removed": removed, "n_spans": count(edge), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept], "kept": kept}
        return pa.table({c: table[c] for c in names} | {c: pa.array(new[c]) for c in added})

    asked = blocks.groupBy(BLOCK).applyInArrow(ask, _ddl(_ASK))
    answers = asked.groupBy(BUCKET).applyInArrow(answer, _ddl(_ANSWER))
    shipped = blocks.groupBy(BLOCK).cogroup(answers.groupBy(BLOCK)).applyInArrow(ship, _ddl(_SHIP))
    found = shipped.groupBy(BUCKET).applyInArrow(match, _ddl(_FOUND))
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in names), *(f"{c} {t}" for c, t in added.items())])
    return blocks.groupBy(BLOCK).cogroup(found.groupBy(BLOCK)).applyInArrow(finish, schema).withColumnsRenamed(back)
