"""Token-id files with Elias-Fano encoded document boundaries.

Documents in ascending doc_id order are encoded and laid end to end. A chunk of up to ``CHUNK`` documents (and about ``CHUNK_BYTES`` of text) is one record
of a Parquet file: its ids as one array of 2 or 4 bytes each, and the ends of its documents and their doc_ids as
Elias-Fano sequences: low bits packed, high bits in unary, and every ``SAMPLE``-th one of the unary part by place, from
which select finds any boundary. A table of 64-bit offsets is never kept.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.llm._vec import pass_ranges
from tonegrid.operators.lineage import shared_folder

CHUNK, CHUNK_BYTES, SAMPLE = 1024, 4_000_000, 128
#: Distinct words that a Python worker remembers, and the longest one.
CACHE_WORDS, CACHE_CHARS = 500_000, 64

#: Words whose parts are plain to see: printable ASCII without a special token's opening, and Latin letters that have
#: one lower-case form and no decomposition to undo.
PLAIN = re.compile(r"(?!.*<\|)[\x21-\x7e\u00c0-\u012f\u0131-\u0148\u014a-\u017e]+")
#: The parts of lower-cased plain words, one word a line, and the line ends.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017e]+|[0-9]|\n|[^\na-z0-9\u00df-\u00f6\u00f8-\u017e]+")
PROBES = ("Don'ts", "it's", "A1b22***'s", "''re", "ÉTÉ×été÷", "a|b|", "!!x...", "Straße", "##'ll9")


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, size: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.size, self.low_bits, self.low, self.high, self.samples = size, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        low_bits = max(0, int(values[-1]) // n).bit_length() - 1 if n and int(values[-1]) // n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)).tobytes()
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, low_bits, low, np.packbits(unary).tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, index: np.ndarray) -> np.ndarray:
        """The values at these places: from the sample before each, on to the wanted one of the unary part."""
        index = np.asarray(index, np.int64)
        out = np.zeros(len(index), np.uint64)
        samples, high = np.frombuffer(self.samples, "<u4").astype(np.int64), np.frombuffer(self.high, np.uint8)
        for s in np.unique(index // SAMPLE).tolist():
            here = np.flatnonzero(index // SAMPLE == s)
            first = samples[s] // 8
            last = samples[s + 1] // 8 + 1 if s + 1 < len(samples) else len(high)
            ones = np.flatnonzero(np.unpackbits(high[first:last])) + first * 8
            ones = ones[ones >= samples[s]]
            i = index[here]
            out[here] = (ones[i - s * SAMPLE] - i).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8))
            at = index[:, None] * self.low_bits + np.arange(self.low_bits)
            out |= (bits[at].astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def parts(self) -> list:
        return [self.low_bits, self.low, self.high, self.samples]


class WordCodec:
    """The tokenizers library, asked once for each distinct word between ASCII white space.

    Words of plain letters fall into the parts that the vocabulary's own pattern makes, lower-cased, so that spellings
    share them; the library encodes many parts in one text, where the token that ends a word ends each part. For a
    vocabulary with other rules (tested on probes, and by the number of ends), and for all other words, each is asked
    by itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.kind = "<u2" if len(vocabulary) <= 1 << 16 else "<u4"
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.plain = all(self._sure(x) for x in PROBES)

    def _sure(self, text: str) -> bool:
        """Whether the library encodes a text as the parts that PARTS cuts it into."""
        ask = lambda t: self.library.encode(t, add_special_tokens=False).ids
        return ask(text) == [i for x in PARTS.findall(text.lower()) for i in ask(x)]

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch(words, add_special_tokens=False)]

    def _together(self, parts: list[str]) -> list[bytes]:
        """The ids of parts, encoded as one text."""
        ids = np.array(self.library.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(parts):
            return self._each(parts)
        return _slices(ids.astype(self.kind).tobytes(), ends * np.dtype(self.kind).itemsize)

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of new words."""
        plain = list(filter(PLAIN.fullmatch, words)) if self.plain else []
        whole = list(set(words).difference(plain))
        known = dict(zip(whole, self._each(whole), strict=True))
        parts = PARTS.findall("\n".join(plain).lower())
        if len(self.parts) > CACHE_WORDS:
            self.parts.clear()
        self.parts["\n"] = b""
        new = list(set(parts).difference(self.parts))
        for i in range(0, len(new), 20_000):
            self.parts.update(zip(new[i : i + 20_000], self._together(new[i : i + 20_000]), strict=True))
        found = list(map(self.parts.__getitem__, parts))
        lines = np.fromiter(map("\n".__eq__, parts), bool, len(parts))
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        known.update(zip(plain, _slices(b"".join(found), np.append(ends[lines], ends[-1:])), strict=True))
        return known

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has; null is empty."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.words) > CACHE_WORDS:
            self.words, self.older = {}, self.words
        known, older = self.words, self.older
        fresh = set(words).difference(known)
        known.update((w, older[w]) for w in fresh.intersection(older))
        fresh.difference_update(older)
        known.update(self._learn(list(fresh)))
        found = list(map(known.__getitem__, words))
        for w in fresh:
            if len(w) > CACHE_CHARS:
                del known[w]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.kind).itemsize
        first = np.cumsum(sizes) - sizes
        word = coded.indices.to_numpy()
        size = sizes[word]
        end = np.cumsum(size)
        ids = np.frombuffer(b"".join(found), self.kind)[np.repeat(first[word] - end + size, size) + np.arange(size.sum())]
        cuts = split.offsets.to_numpy()
        return ids, np.diff(np.append(0, end)[cuts - cuts[0]])


def _slices(data: bytes, ends: np.ndarray) -> list[bytes]:
    cuts = [0, *ends.tolist()]
    return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


_codecs: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]


_EF = lambda name: f"{name}_bits int, {name}_low binary, {name}_high binary, {name}_samples binary"
_RECORD = f"shard int, chunk long, before long, n_null int, n_docs int, n_ids long, width int, ids binary, first_id long, {_EF('ends')}, {_EF('doc_ids')}"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Writes the texts of ``docs`` (doc_id: long, text: string), each with ``end_id`` behind it, as token files.

    Ascending doc_id, null ids first; rows with the same id in the order of their texts' hashes. A null text is empty.
    """
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 32_000_000))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        from pyspark import TaskContext

        shard, use, chunk, before = TaskContext.get().partitionId(), codec(tokenizer), 0, 0
        width = np.dtype(use.kind).itemsize
        for batch in batches:
            sizes = pc.binary_length(batch["text"]).fill_null(0).to_numpy(zero_copy_only=False)
            cuts = [x for a, b in pass_ranges(sizes, CHUNK_BYTES) for x in range(a, b, CHUNK)]
            for lo, hi in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                part = batch.slice(lo, hi - lo)
                ids = part["doc_id"]
                found, sizes = use.encode(part["text"])
                ends = np.cumsum(sizes + 1)
                flat = np.full(len(found) + len(part), end_id, use.kind)
                own = np.ones(len(flat), bool)
                own[ends - 1] = False
                flat[own] = found
                own = ids.drop_null().to_numpy()
                base = int(own[0]) if len(own) else 0
                size = len(flat)
                row = [shard, chunk, before, ids.null_count, len(part), size, width, flat.tobytes(), base, *EliasFano.of(ends).parts(), *EliasFano.of((own - base).astype(np.uint64)).parts()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES, strict=True)], names=_NAMES)
                chunk, before = chunk + 1, before + size

    ordered.select("doc_id", "text").mapInArrow(run, _RECORD).write.parquet(path)


_NAMES = [x.split()[0] for x in _RECORD.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _RECORD.split(", ")]


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and ids if wanted) of each document of the token files."""
    records = spark.read.schema(_RECORD).parquet(path)
    shards = [tuple(r) for r in records.groupBy("shard").agg(F.sum("n_ids")).orderBy("shard").collect()]  # a row for each file
    before = np.cumsum([0, *(n for _, n in shards)])
    offsets = {s: int(b) for (s, _), b in zip(shards, before, strict=False)}  # one number for each file

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ef = lambda name, n, r=r: EliasFano(n, *(r[f"{name}_{k}"] for k in ("bits", "low", "high", "samples")))
                n, own = r["n_docs"], r["n_docs"] - r["n_null"]
                ends = ef("ends", n).select(np.arange(n)).astype(np.int64)
                doc_ids = [None] * r["n_null"] + (ef("doc_ids", own).select(np.arange(own)).astype(np.int64) + r["first_id"]).tolist()
                flat = np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4")
                starts = np.append(0, ends[:-1])
                cols = {"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(starts + offsets[r["shard"]] + r["before"]), "n_tokens": pa.array(ends - starts), "ids_crc32": pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)], pa.int64())}
                if ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(cols)

    return records.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else ""))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes token files into the shared folder and reads the documents' digests back from them."""
    path = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path, ids=False)
