"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes pre-tokens that no merge can join; each has a score-ordered agenda of adjacent symbol pairs: the best
pair merges first, the leftmost on ties, and its new neighbours enter the agenda. The agendas of all new pre-tokens of a
batch advance together: in each step, every agenda gives up its best pair. A long pre-token keeps its agenda in a heap,
as steps over it would grow with its square. Each distinct pre-token of an Arrow batch is checked against the
sentencepiece library, whose ids hold if the two should ever differ.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tonegrid.llm._vec import pass_ranges, release, rows

SPACE = "▁"
#: A pair that is no piece comes after all others.
NEVER = 1 << 30
#: Longest pre-token whose agenda advances with the others.
TOGETHER = 64
#: Distinct pre-tokens, and words, that a Python worker remembers, and the longest one that it does.
CACHE_WORDS, CACHE_CHARS = 100_000, 48


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Pairs:
    """Rank by score and merged symbol of each pair of symbols that makes a piece: an open-addressed table."""

    def __init__(self, pairs: dict[int, tuple[int, int]]):
        self.shift = np.uint64(64 - max(8, (4 * len(pairs)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask, self.keys, self.entry = size - 1, np.full(size, -1, np.int64), np.zeros(size, np.int64)
        keys, self.rank, self.merged = np.fromiter(pairs, np.int64, len(pairs)), *(np.append(np.fromiter((x[k] for x in pairs.values()), np.int64, len(pairs)), last) for k, last in ((0, NEVER), (1, -1)))
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]
            self.entry[slot[free]] = free
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = slot[left] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in rank and merged; the last one if it makes no piece."""
        keys = np.where((left >= 0) & (right >= 0), left << 24 | right, -2)
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.entry[slot], len(self.rank) - 1)
        more = np.flatnonzero((seen != keys) & (seen >= 0) & (keys >= 0))
        while len(more):
            slot[more] = slot[more] + 1 & self.mask
            seen = self.keys[slot[more]]
            hit = seen == keys[more]
            out[more[hit]] = self.entry[slot[more[hit]]]
            more = more[~hit & (seen >= 0)]
        return out


class PieceCodec:
    """Encodes and decodes with the merge-type vocabulary of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.get_piece_size())
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        special = lambda i: lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)
        self.ids = {lib.id_to_piece(i): i for i in ids if not special(i)}
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items() if not lib.is_unused(i)}
        self.byte_ids = {int(lib.id_to_piece(i)[1:-1], 16): i for i in ids if lib.is_byte(i)}
        self.bytes = [b"" if lib.is_control(i) else b" \xe2\x81\x87 " if lib.is_unknown(i) else bytes([int(lib.id_to_piece(i)[1:-1], 16)]) if lib.is_byte(i) else lib.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        sizes = np.array([len(x) for x in self.bytes])
        self.text, self.text_size, self.text_start = np.frombuffer(b"".join(self.bytes), np.uint8), sizes, np.cumsum(sizes) - sizes
        chars = sorted({x for p in self.ids for x in p})
        symbols = {x: self.ids.get(x, len(self.bytes) + k) for k, x in enumerate(chars)}
        self.symbol = -1 - np.arange(0x110000)  # of each character: a piece, a character of pieces, or none of these
        self.symbol[[ord(x) for x in symbols]] = list(symbols.values())
        symbols |= {p: self.ids[p] for p in self.scores}
        ranks = {x: i for i, x in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.pairs = Pairs({symbols[p[:i]] << 24 | symbols[p[i:]]: (ranks[x], symbols[p]) for p, x in self.scores.items() for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols})
        self.line = "\n" if self.byte_ids and not any("\n" in p for p in self.ids) else ""
        self.apart = all(SPACE not in p.lstrip(SPACE) for p in self.ids)  # no piece has a space inside or at its end
        self.pattern = self._boundaries()
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _boundaries(self) -> re.Pattern:
        """Matches pre-tokens; between them, the vocabulary has no piece that a merge could make."""
        gap, line = SPACE, self.line
        odd = re.escape("".join(sorted({x for p in self.ids for x in p if re.match(r"[^\W\d_]", x) and not x.isalpha()})))
        letter = rf"(?:(?![{odd}])[^\W\d_])" if odd else r"[^\W\d_]"
        other = rf"(?:[^\w{gap}{line}]|[\d_{odd}])"
        end = f"|{line}" if line else ""
        for body in (f"{letter}+|{gap}*{other}+", f"[^{gap}{line}]+"):  # letters apart from the rest, or words
            if all(re.fullmatch(f"{gap}*(?:{body})|{gap}+", p) for p in self.ids):
                return re.compile(f"{gap}*{body}|{gap}+{end}")
        return re.compile(r"(?s:.+)")

    def merge(self, word: str) -> list[int]:
        """Ids of a pre-token, by the agenda."""
        scores = self.scores
        symbols: list[str] = list(word)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(-scores[p], i, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in scores]
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i]
            if j >= n or not symbols[i] or symbols[i] + symbols[j] != pair:
                continue  # one of the two has merged otherwise
            symbols[i], symbols[j] = pair, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := pair + symbols[k]) in scores:
                    heapq.heappush(agenda, (-scores[p], i, p))
            if (h := before[i]) >= 0 and (p := symbols[h] + pair) in scores:
                heapq.heappush(agenda, (-scores[p], h, p))
        return self._ids(filter(None, symbols))

    def _ids(self, symbols: Iterable[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in s.encode())
            else:
                out.append(self.unk)
        return out

    def merge_all(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens of up to TOGETHER characters, by agendas that advance together."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        symbol, word = self.symbol[codes], np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        ended_symbols, ended_words = [], []
        pair = np.full(len(symbol), len(self.pairs.rank) - 1)
        inner = np.flatnonzero(word[1:] == word[:-1])
        pair[inner] = self.pairs.find(symbol[inner], symbol[inner + 1])
        while len(symbol):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(word)))
            best = np.minimum.reduceat(self.pairs.rank[pair] << 32 | np.arange(len(pair)), first)
            live = best >> 32 < NEVER
            over = np.repeat(~live, size)
            ended_symbols.append(symbol[over])
            ended_words.append(word[over])
            at = best[live] & 0xFFFFFFFF
            symbol[at] = self.pairs.merged[pair[at]]
            stays = ~over
            stays[at + 1] = False
            at = (np.cumsum(stays) - 1)[at]
            symbol, word, pair = symbol[stays], word[stays], pair[stays]
            pair[at] = len(self.pairs.rank) - 1
            changed = np.concatenate([at, at[at > 0] - 1])
            changed = changed[changed + 1 < len(word)]
            changed = changed[word[changed] == word[changed + 1]]
            pair[changed] = self.pairs.find(symbol[changed], symbol[changed + 1])
        symbol, word = np.concatenate([np.zeros(0, np.int64), *ended_symbols]), np.concatenate([np.zeros(0, np.int64), *ended_words])
        order = np.argsort(word, kind="stable")
        symbol = symbol[order]
        cuts = np.cumsum(np.bincount(word, minlength=len(words)))
        data = symbol.astype("<u4").tobytes()
        out = [data[4 * a : 4 * b] for a, b in zip([0, *cuts.tolist()], cuts.tolist(), strict=False)]
        for i in np.unique(word[order][(symbol < 0) | (symbol >= len(self.bytes))]).tolist():  # characters that are no pieces
            out[i] = _packed(self.merge(words[i]))
        return out

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of the pre-tokens as bytes, each checked against the library."""
        short = [w for w in words if len(w) <= TOGETHER]
        own = dict(zip(short, self.merge_all(short), strict=True))
        own |= {w: _packed(self.merge(w)) for w in words if len(w) > TOGETHER}
        if not self.line:
            return own
        probe = [w[1:] if w[0] == SPACE else self.line + w for w in words]
        lead = len(self.library.encode(self.line))
        for w, theirs in zip(words, self.library.encode(probe, num_threads=1), strict=True):
            if w != SPACE and own[w] != (theirs := _packed(theirs if w[0] == SPACE else theirs[lead:])):  # for a lone space, it sees no text
                own[w] = theirs
        return own

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of runs of pre-tokens."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        if len(self.words) > CACHE_WORDS:  # what is used again moves on from the older half
            self.words, self.older = {}, self.words
        cache, words_of, older = self.cache, self.words, self.older
        fresh = set(words).difference(words_of)
        words_of.update((w, older[w]) for w in fresh.intersection(older))
        fresh.difference_update(older)
        parts = {w: self.pattern.findall(w) for w in fresh}
        new = list({x for found in parts.values() for x in found}.difference(cache))
        if new:
            cache.update(self._learn(new))
        for w, found in parts.items():
            words_of[w] = cache[found[0]] if len(found) == 1 else b"".join(map(cache.__getitem__, found))
        out = list(map(words_of.__getitem__, words))
        for held, added in ((cache, new), (words_of, fresh)):
            for w in added:
                if len(w) > CACHE_CHARS:
                    del held[w]
        return out

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Begin, the text's ids and end of all texts in one, and where each text's end; null is empty."""
        texts = texts.fill_null("")
        has = lambda x: pc.match_substring(texts, x)
        mark = next(m for m in map(chr, range(1, 0x110000)) if m not in (" ", "\n", SPACE) and not "\ud800" <= m <= "\udfff" and not pc.any(has(m)).as_py())
        # a cut before each space and line end, where it is plain to see
        plain = pc.invert(pc.or_(pc.or_(has("  "), has(SPACE)), pc.starts_with(texts, " "))) if self.apart else pa.array(np.zeros(len(texts), bool))
        marked = pc.replace_substring(texts, " ", mark + SPACE)
        marked = pc.replace_substring(marked, "\n", mark + "\n") if self.line else marked
        spaced = pc.if_else(plain, marked, pc.replace_substring(texts, " ", SPACE))
        lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(SPACE, texts.type), spaced, pa.scalar("", texts.type)), mark)
        some = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        found = self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        word = coded.indices.to_numpy()
        size = sizes[word]
        end = np.cumsum(size)
        own = np.frombuffer(b"".join(found), "<u4")[np.repeat((np.cumsum(sizes) - sizes)[word] - end + size, size) + np.arange(size.sum())]
        cuts = lists.offsets.to_numpy()
        counts = np.diff(np.append(0, end)[cuts - cuts[0]]) * some
        ends = np.cumsum(counts + 2)
        ids = np.empty(ends[-1] if len(ends) else 0, "<u4")
        inside = np.ones(len(ids), bool)
        inside[ends - 1] = inside[ends - counts - 2] = False
        ids[ends - counts - 2], ids[ends - 1] = self.bos, self.eos
        ids[inside] = own[np.repeat(some, np.diff(np.append(0, end)[cuts - cuts[0]]))]
        return ids, ends

    def decode(self, ids: bytes) -> str:
        """Text of ids as the library's decode gives it; bytes that are no UTF-8 become U+FFFD each."""
        data = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        data = data[1:] if data[:1] == b" " else data
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self.library.decode(np.frombuffer(ids, "<u4").tolist())

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The texts of ids, as by decode, in UTF-8."""
        size = self.text_size[ids]
        end = np.cumsum(size)
        data = self.text[np.repeat(self.text_start[ids] - end + size, size) + np.arange(size.sum())].tobytes()
        first = np.append(0, ends)
        cuts = np.append(0, end)[first].tolist()
        out = []
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            x = data[a + (data[a : a + 1] == b" ") : b]
            try:
                x.decode()
            except UnicodeDecodeError:
                x = self.library.decode(ids[first[i] : first[i + 1]].tolist()).encode()
            out.append(x)
        return out


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One per Python worker and model file."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


#: Bytes of text that are encoded at a time.
STEP_BYTES = 1_000_000


def encode_pieces(docs: DataFrame, model: str, keep: list[str], ids: bool = True, decoded: bool = True) -> DataFrame:
    """The columns ``keep`` of ``docs`` (text: string) with n_tokens, ids_sha256, decoded_sha256, and if wanted
    piece_ids (array of int) and decoded (string).

    Null and empty texts are begin and end alone and decode to the empty text. Every row is encoded whole and by
    itself. Clashing names: the added columns win.
    """
    added = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), *([("piece_ids", "array<int>")] if ids else []), *([("decoded", "string")] if decoded else [])]
    keep = [c for c in keep if c not in dict(added)]
    arrow = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def run(batches):
        use = codec(model)
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(c) for c in keep), *(pa.field(c, arrow[t]) for c, t in added)])
            sizes = pc.binary_length(batch["text"]).fill_null(0).to_numpy(zero_copy_only=False)
            for start, stop in pass_ranges(sizes, STEP_BYTES):
                part = batch.slice(start, stop - start)
                found, ends = use.encode_batch(part["text"])
                text = use.decode_batch(found, ends)
                cuts = [0, *ends.tolist()]
                of = [found[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                new = {"n_tokens": np.diff(cuts), "ids_sha256": [hashlib.sha256(x).hexdigest() for x in of], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in text]}
                if ids:
                    new |= {"piece_ids": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(found.view("<i4")))}
                if decoded:
                    new["decoded"] = [x.decode() for x in text]
                yield rows(schema, **{c: part[c] for c in keep}, **new)
        release()

    fields = {f.name: f for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {fields[c].dataType.simpleString()}" for c in keep), *(f"{c} {t}" for c, t in added)])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
