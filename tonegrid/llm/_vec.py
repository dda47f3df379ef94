"""Vectorised text primitives that run inside Spark tasks (numpy over Arrow buffers)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised pass holds at a time; a longer text is a pass of its own.
PASS_BYTES = 2_000_000

U = np.uint64
_R1, _R2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so invertible modulo 2**64
_R3 = 0xD1342543DE82EF9B  # 3 modulo 8, so its powers keep apart longest
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_table(keep: Iterable[int]) -> np.ndarray:
    """True at each of the byte values."""
    table = np.zeros(256, bool)
    table[list(keep)] = True
    return table


#: Words ``[^\x20\x09-\x0D]+``, and words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z.
NOT_SPACE = ~byte_table([0x20, *range(0x09, 0x0E)])
ALNUM = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def pass_ranges(sizes: Iterable[int], limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that together hold at most ``limit`` bytes, or a single row."""
    start = held = 0
    i = -1
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size + 1
    if start <= i:
        yield start, i + 1


def passes(texts: list[bytes], limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts, as by pass_ranges."""
    return pass_ranges(map(len, texts), limit)


def flatten(texts: list[bytes], gap: bytes = b" ") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes with ``gap`` behind each text; where each text starts and ends."""
    data = np.frombuffer(gap.join(texts) + gap, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + len(gap)) - sizes - len(gap)
    return data, starts, starts + sizes


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> U(32))
    x = x * U(_R2)
    x ^= x >> U(29)
    x *= U(0xA0761D6478BD642F)
    x ^= x >> U(32)
    return x


def powers(root: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """root**k and its inverse modulo 2**64, for k up to n at least."""
    if root not in _powers or len(_powers[root][0]) <= n:
        size = max(n + 1, PASS_BYTES + 1024)
        up, down = np.full(size, root, U), np.full(size, pow(root, -1, 1 << 64), U)
        up[0] = down[0] = 1
        _powers[root] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers[root]


class Rolling:
    """Hashes of any byte ranges in constant time each, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, root: int = _R1):
        up, self.down = powers(root, len(data))
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed with the length, so that ranges of different lengths differ."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U) * U(_R2))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as an integer; those past the end are zero."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range: the sum of its mixed pieces of eight bytes, each mixed again with its place.

    No pair of different ranges is likelier than others to collide, and hashes of different salts share no step.
    """
    eights = _eights(data)
    size = end - start
    pieces = np.maximum(-(-size // 8), 1)
    first = np.cumsum(pieces) - pieces
    place = np.arange(pieces.sum()) - np.repeat(first, pieces)
    at = np.repeat(start, pieces) + 8 * place
    left = np.minimum(np.repeat(end, pieces) - at, 8).astype(U)
    piece = eights[at] & np.where(left == U(8), ~U(0), (U(1) << (U(8) * left)) - U(1))
    piece = mix(mix(piece ^ U(salt)) + (place.astype(U) + U(1)) * U(_R1))
    return mix((np.add.reduceat(piece, first) if len(first) else np.zeros(0, U)) + size.astype(U) * U(_R2) + U(salt))


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """A number for the sixteen bytes from each place on: equal bytes, equal numbers, in an order that looks random."""
    eights = _eights(data)[:-1]
    out = eights[:-8] * U(_R1) ^ (eights[8:] * U(_R2) >> U(29))
    out *= U(0xA0761D6478BD642F)
    out ^= out >> U(32)
    return out[: max(0, len(data) - 15)]


def window_hashes(data: np.ndarray, starts: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes (8 at least) from each start on.

    A polynomial over mixed pieces of eight bytes, from prefix sums of every eighth place. Only a polynomial of thousands
    of pieces would have structured strings that collide, so lengths are at most some thousand bytes.
    """
    eights = _eights(data)
    pieces = length // 8
    n = -(-len(data) // 8) * 8
    mixed = np.zeros(n, U)
    mixed[: len(data)] = mix(eights[:-1] ^ U(salt))
    up, down = powers(_R3, n // 8)
    sums = np.zeros((n // 8 + 1, 8), U)
    np.cumsum(mixed.reshape(-1, 8) * up[: n // 8, None], axis=0, out=sums[1:])
    row, column = starts >> 3, starts & 7
    out = (sums[row + pieces, column] - sums[row, column]) * down[row]
    return mix(out + mixed[starts + length - 8] * U(_R2) + U(length) * U(_R1) + U(salt))


class Words:
    """The words of some texts: byte ranges, hashes, and each text's range of words."""

    def __init__(self, texts: list[bytes], table: np.ndarray, lower: bool = False):
        self.data, self.text_start, self.text_end = flatten(texts)
        if lower:
            self.data = LOWER[self.data]
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = table[self.data]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, self.text_start)
        self.last = np.append(self.first[1:], len(self.start))
        self.count = self.last - self.first
        self.hash = range_hashes(self.data, self.start, self.end)

    @property
    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def grams(self, n: int, root: int = _R1, salt: int = 0) -> np.ndarray:
        """Hash of the n words from each word on; meaningless for the last n - 1 words of a text."""
        words = range_hashes(self.data, self.start, self.end, salt) if salt else self.hash
        out = np.zeros(len(words), U)
        for k in range(min(n, len(words))):
            out[: len(words) - k] = out[: len(words) - k] * U(root) + words[k:]
        return mix(out)

    def room(self, n: int) -> np.ndarray:
        """True where n words of the same text start."""
        ends = np.repeat(self.last, self.count)
        return np.arange(len(self.start)) + n <= ends


def covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """True at each of ``size`` places within ``length`` from one of ``starts``."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, size), -1)
    return np.cumsum(step)[:-1] > 0


def release() -> None:
    """Gives memory that a task has freed back to the system, where the C library can; idle workers then hold little."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch with these columns, in the order of the schema."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)
