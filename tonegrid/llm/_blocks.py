"""Documents dealt into blocks by the hash of their id and text, and the exchange of packed hashes between blocks and buckets.

A block is what one call of a grouped Arrow function holds: about ``BLOCK_BYTES`` of text, whatever the size of the
corpus. What a block asks of the others goes out as rows of packed hashes, one row per bucket, each distinct hash once
per block; so a string that a third of all documents share comes once from each block, not once from each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrid.llm._vec import mix, utf8

BLOCK, BUCKET = "__block", "__bucket"
#: Bytes of text for a block, and for a bucket; LEAST of both, so that small inputs still spread.
BLOCK_BYTES, BUCKET_BYTES, LEAST = 2_000_000, 16_000_000, 512
_KINDS = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
ASK = pa.schema([(BUCKET, pa.int64()), (BLOCK, pa.int32()), ("h", pa.binary())])
ANSWER = pa.schema([(BLOCK, pa.int32()), (BUCKET, pa.int64()), ("bits", pa.binary()), ("found", pa.binary())])
#: Bytes of a hash that is asked about; the rest only confirms.
ASKED_BYTES = 6
#: Stands for a null id: larger than any other.
NO_ID = np.iinfo(np.int64).max


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_KINDS[f.type]}" for f in schema)


def dealt(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """The columns with each row's block, and the number of buckets for what blocks exchange."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(LEAST, -(-total // BLOCK_BYTES))
    buckets = max(LEAST, -(-total // BUCKET_BYTES))
    return docs.select(*columns, F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias(BLOCK)), buckets


def in_order(block: pa.Table) -> pa.Table:
    """The block's rows by id and text: the same order whenever the block is made anew."""
    ids = block["doc_id"]
    keys = [("doc_id", "ascending")] if pc.count_distinct(ids, mode="all").as_py() == len(ids) else [("doc_id", "ascending"), ("text", "ascending")]
    return block.take(pc.sort_indices(block.select(["doc_id", "text"]), sort_keys=keys, null_placement="at_end"))


def ids_and_texts(block: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    return block["doc_id"].fill_null(NO_ID).to_numpy().astype(np.int64), utf8(block["text"])


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(hashes) % np.uint64(buckets)).astype(np.int64)


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, int, int]]]:
    """A stable order by bucket, and each bucket's range in it."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cut = np.flatnonzero(np.diff(sorted_)) + 1
    starts, ends = np.append(0, cut), np.append(cut, len(sorted_))
    return order, zip(sorted_[starts].tolist() if len(sorted_) else [], starts.tolist(), ends.tolist(), strict=False)


def runs_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: where each run of equal ones starts, and each row's run."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def packed(arrays: np.ndarray, width: int) -> bytes:
    """The high ``width`` bytes of 64-bit integers."""
    return arrays.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view(">u8").ravel().astype(np.uint64)


def joined(column: pa.ChunkedArray) -> tuple[bytes, np.ndarray]:
    """All binaries of a column in one, and their sizes."""
    parts = column.to_pylist()
    return b"".join(x or b"" for x in parts), np.array([len(x or b"") for x in parts], np.int64)


def asked(hashes: np.ndarray, block: int, buckets: int) -> pa.Table:
    """Rows ASK for a block's distinct hashes, one for each bucket."""
    order, ranges = by_bucket(bucket_of(hashes, buckets))
    out = [(k, packed(hashes[order[lo:hi]], ASKED_BYTES)) for k, lo, hi in ranges]
    return pa.table([[k for k, _ in out], [block] * len(out), [h for _, h in out]], schema=ASK)


def seen_twice(table: pa.Table) -> pa.Table:
    """Rows ANSWER for a bucket's rows ASK: a bit for each hash, set if two blocks asked about it; none where no bit is set."""
    data, sizes = joined(table["h"])
    hashes = unpacked(data, ASKED_BYTES)
    order = np.argsort(hashes, kind="stable")
    starts, run = runs_of(hashes[order])
    twice = np.zeros(len(hashes), bool)
    twice[order] = np.diff(np.append(starts, len(order)))[run] > 1
    sizes //= ASKED_BYTES
    ends = np.cumsum(sizes)
    out = [(b, np.packbits(twice[hi - n : hi]).tobytes()) for b, hi, n in zip(table[BLOCK].to_pylist(), ends.tolist(), sizes.tolist(), strict=True) if twice[hi - n : hi].any()]
    return pa.table([[b for b, _ in out], [table[BUCKET][0].as_py()] * len(out), [x for _, x in out], [None] * len(out)], schema=ANSWER)


def told(hashes: np.ndarray, buckets: int, answers: pa.Table) -> np.ndarray:
    """Which of a block's distinct hashes another block asked about too."""
    order, ranges = by_bucket(bucket_of(hashes, buckets))
    at = {k: (lo, hi) for k, lo, hi in ranges}
    out = np.zeros(len(hashes), bool)
    for bucket, bits in zip(answers[BUCKET].to_pylist(), answers["bits"].to_pylist(), strict=True):
        lo, hi = at[bucket]
        out[order[lo:hi]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
    return out
