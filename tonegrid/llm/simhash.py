"""SimHash near-dedup with pigeonring filtering.

A fingerprint of 64 bits is cut into 2 * max_bits + 1 segments on a ring. If two fingerprints differ in at most
``max_bits`` bits, then from some segment on every chain of l consecutive segments differs in at most
floor(l * max_bits / segments) bits; so its first two segments agree. Fingerprints meet where two consecutive segments
agree; the rest of the chain is walked segment by segment and prunes whatever exceeds a budget, and the full Hamming
distance decides on what is left. Some chain of any pair passes, so a group need only link the pairs whose chain starts
at its own segment.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrid.llm._blocks import runs_of
from tonegrid.llm._vec import utf8
from tonegrid.llm.components import components, local_roots
from tonegrid.operators.lineage import cut

WORDS, MAX_BITS, SEED = 3, 2, 42
#: Fingerprints that meet in one group; a larger one is split over tasks by the next segments of the chain.
GROUP = 2048
#: Bits of a segment, at most 16.
WIDEST = 13
#: Shingles hashed at a time.
STEP = 200_000


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64-bit SimHash over the XXH64 of all word shingles, repeats included; 0 without words."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    n = max(1, len(parts) - words + 1)
    starts = np.append(0, ends[:-1] + 1)[:n].tolist()
    ends = ends[min(words, len(parts)) - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for i in range(0, n, STEP):
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(starts[i : i + STEP], ends[i : i + STEP], strict=True)], repeat(SEED)), ">u8", min(STEP, n - i))
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp: long with the 64 bits) of each row of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x, words) for x in utf8(batch["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(low bit, width) of each segment on the ring."""
    n = 2 * max_bits + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _part(low: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))


def _masks(width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All masks of at most ``bits`` set bits, the fewest first, and how many each has."""
    masks, reach = [0], {0}
    for _ in range(bits):
        reach = {m | (1 << k) for m in reach for k in range(width)} - set(masks)
        masks += sorted(reach)
    out = np.array(masks, np.uint64)
    return out, np.bitwise_count(out).astype(np.int64)


def _chained(group: np.ndarray, parts: np.ndarray, budgets: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group whose chains keep within their budgets.

    Rows are sorted by (group, parts); parts has a column for each further segment of the chain, budgets what all
    segments so far may differ in. Rows with equal beginnings are one branch; branches meet segment by segment, each
    looking up the values within what is left of its budget, so a pair that breaks a budget goes no further.
    """
    starts, of = runs_of(group)
    one, two, used = np.arange(len(starts)), np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for k, budget in enumerate(budgets):
        heads, under = runs_of(of, parts[:, k])  # branches with one more segment
        parent, value = of[heads], parts[heads, k]
        key = (parent.astype(np.uint64) << np.uint64(16)) | value
        first = np.searchsorted(parent, np.arange(len(starts) + 1))
        masks, bits = _masks(WIDEST, budget)
        left, right, cost = [], [], []
        for mask, n in zip(masks, bits, strict=True):
            open_ = np.flatnonzero(used + n <= budget)
            sizes = np.diff(first)[one[open_]]
            pair = np.repeat(open_, sizes)
            child = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[:-1][one[pair]]
            wanted = (two[pair].astype(np.uint64) << np.uint64(16)) | (value[child] ^ mask)
            at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            hit = (key[at] == wanted) & ((one[pair] != two[pair]) | (child <= at))  # within one branch, each pair once
            left.append(child[hit])
            right.append(at[hit])
            cost.append((used[pair] + n)[hit])
        one, two, used, of, starts = np.concatenate(left), np.concatenate(right), np.concatenate(cost), under, heads
    return starts[one], starts[two]


def link(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that join all of ``nodes`` (node, distinct fp) within ``max_bits`` bits, over chains of links.

    A group's pairs go through their chain segment by segment, and only what keeps every budget has its Hamming distance
    counted. Only a forest of links comes out, so the number of rows never grows with the square of a group.
    """
    ring = _segments(max_bits)
    n = len(ring)
    at = lambda i, k: _part(*ring[(i + k) % n])
    keyed = nodes.select("node", "fp", F.explode(F.array(*(F.struct(F.lit(i).alias("start"), at(i, 0).alias("s0"), at(i, 1).alias("s1")) for i in range(n)))).alias("k")).select("node", "fp", "k.*")
    large = keyed.groupBy("start", "s0", "s1").count().where(F.col("count") > GROUP).select("start", "s0", "s1", F.lit(True).alias("large"))
    keyed = keyed.join(large, ["start", "s0", "s1"], "left")
    # of a chain's third and fourth segments one agrees, as both together differ in one bit at most
    third = lambda k: F.coalesce(*(F.when(F.col("start") == i, at(i, k)) for i in range(n)))
    further = F.when(F.col("large"), F.array(F.struct(F.lit(2).alias("which"), third(2).alias("s2")), F.struct(F.lit(3).alias("which"), third(3).alias("s2")))).otherwise(F.array(F.struct(F.lit(0).alias("which"), F.lit(0).cast("long").alias("s2"))))
    keyed = keyed.select("node", "fp", "start", "s0", "s1", F.explode(further).alias("f"))
    low, wide = np.array([r[0] for r in ring], np.uint64), np.array([r[1] for r in ring], np.uint64)
    budgets = [(k + 1) * max_bits // n for k in range(2, n)]
    groups = keyed.groupBy("start", "s0", "s1", "f.which", "f.s2").agg(F.collect_list(F.struct("node", "fp")).alias("held")).where(F.size("held") > 1).select("start", "held")

    def run(batches):
        for batch in batches:
            held, flat = batch["held"], batch["held"].values
            cuts = held.offsets.to_numpy()
            lo, hi = int(cuts[0]), int(cuts[-1])
            node, fp = flat.field("node").to_numpy()[lo:hi], flat.field("fp").to_numpy()[lo:hi].view(np.uint64)
            group = np.repeat(np.arange(len(batch)), np.diff(cuts))
            places = (batch["start"].to_numpy()[group][:, None] + np.arange(2, n)) % n  # the first two segments agree
            parts = (fp[:, None] >> low[places]) & ((np.uint64(1) << wide[places]) - np.uint64(1))
            order = np.lexsort((*parts.T[::-1], group))
            left, right = _chained(group[order], parts[order], budgets)
            left, right = order[left], order[right]
            near = (left != right) & (np.bitwise_count(fp[left] ^ fp[right]) <= max_bits)  # the full Hamming check, of survivors
            rank = np.empty(len(node), np.int64)
            by_node = np.lexsort((node, group))
            rank[by_node] = np.arange(len(node))
            root = local_roots(len(node), rank[left[near]], rank[right[near]])
            far = np.flatnonzero(root != np.arange(len(node)))
            ids = node[by_node]
            yield pa.RecordBatch.from_arrays([pa.array(ids[root[far]]), pa.array(ids[far])], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs`` (doc_id: long, text: string).

    fingerprint: 16 hex digits. component_id: the smallest doc_id reachable over links between fingerprints that differ
    in at most ``max_bits`` (2 at least) bits, itself included. Texts without words, null too, have fingerprint zero
    and link like any other, and so do rows without an id; a component's smallest id is null only where it has no other.
    """
    if max_bits < 2:
        raise ValueError("max_bits must be 2 at least")
    prints = cut(fingerprints(docs, words))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(link(nodes.select(F.col("fp").alias("node"), "fp"), max_bits))
    named = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    # a component's fingerprints meet in its minimum alone, counted before the exchange; back, adaptive execution splits a large one
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
