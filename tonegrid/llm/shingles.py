"""SimHash near-dedup carried to a stated similarity: every pair of texts whose sets of word shingles are similar enough.

Pigeonring filtering over SimHash fingerprints (``simhash``) proposes the close copies. As fingerprints of texts at a
Jaccard similarity of 0.8 may differ in any number of bits, what they miss comes from a complete prefix-filtered join:
shingles have one order (those that a sample finds frequent come last); of a set of s, ceil(4 s / 5) at least must be
shared, so two such sets share one of their first s - ceil(4 s / 5) + 1 shingles. Sizes, places and sketches bound what a
proposed pair can share, and the sets themselves decide. The sample only shapes the order, and any order is complete.

Blocks of documents exchange the prefix shingles as packed hashes, as in substring dedup, so only shingles that two
sets share become rows; sets travel once for each pair that is left to decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrid.llm._blocks import ANSWER, ASK, BLOCK, BUCKET, asked, ddl, dealt, ids_and_texts, in_order, packed, runs_of, seen_twice, told, unpacked
from tonegrid.llm._vec import NOT_SPACE, Words, passes, release, utf8
from tonegrid.llm.components import components
from tonegrid.llm.simhash import link
from tonegrid.operators.lineage import cut, cut_short

#: Words of a shingle, and the least similarity as a fraction.
WORDS, SHARED, OF = 5, 4, 5
#: The texts of about so many distinct sets tell which shingles are frequent (LEAST times or more); so many are ranked.
SAMPLE, LEAST, RANKED = 4096, 3, 50_000
#: Pairs of places of a group that are compared at a time.
TABLE = 500_000
#: Bytes of text whose sets a task holds at a time.
STEP = 500_000
#: Fewest bits of a sketch; it has a bit for each shingle at least.
SKETCH = 256
#: Words of 64 bits of the sketches that are compared at a time.
COMPARED = 500_000
#: Bytes of a shingle's hash that travel with its set.
SENT = 6
#: Values that ids are hashed to, for a filter of bounded size before texts are exchanged.
HASHES = 1 << 20
#: Entries of groups around one part that meet in one task.
TOGETHER = 50_000
#: Sets that are compared with one set in one task.
MEMBERS = 256

_ENTRY = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("at", pa.int32())])
_SHIP = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("salt", pa.int32()), ("set", pa.binary())])


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles; a shorter text is one shingle, without words none."""
    out = []
    for lo, hi in passes(texts, STEP):
        w = Words(texts[lo:hi], NOT_SPACE, lower=True)
        grams = w.grams(words)
        short = {n: w.grams(n) for n in {*w.count.tolist()} if 0 < n < words}
        for a, n in zip(w.first.tolist(), w.count.tolist(), strict=True):
            out.append(np.unique(grams[a : a + n - words + 1]) if n >= words else short[n][a : a + 1] if n else grams[:0])
    return out


def name_of(s: np.ndarray) -> int:
    """A set's node."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def sketch(s: np.ndarray) -> bytes:
    """Parities of how many shingles fall on each bit: sketches differ in no more bits than sets in shingles.

    The number of bits is a power of two, so a longer sketch folds onto a shorter one.
    """
    bits = max(SKETCH, 1 << (len(s) - 1).bit_length() if len(s) else 0)
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def set_print(s: np.ndarray) -> int:
    """The 64-bit SimHash of a set of hashes."""
    bits = 2 * np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) > len(s)
    return int(np.packbits(bits).view(np.int64)[0])


def _may_share(s1, s2, rest1, rest2) -> Column:
    """Whether sets of these sizes with so many shingles left can be similar; for columns and for arrays."""
    least, most = (np.minimum, np.maximum) if isinstance(s1, np.ndarray) else (F.least, F.greatest)
    return (OF * least(s1, s2) >= SHARED * most(s1, s2)) & ((OF + SHARED) * least(rest1, rest2) >= SHARED * (s1 + s2))


class Sketches:
    """The sketches of a column, and in how many bits they differ."""

    def __init__(self, column: pa.Array):
        self.words = np.frombuffer(b"".join(column.to_pylist()), np.uint64)
        self.size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 8
        self.start = np.cumsum(self.size) - self.size

    def _of(self, at: np.ndarray, size: int, least: int) -> np.ndarray:
        words = self.words[self.start[at][:, None] + np.arange(size)]
        while words.shape[1] > least:
            words = words[:, : words.shape[1] // 2] ^ words[:, words.shape[1] // 2 :]
        return words

    def differ(self, at: np.ndarray, other: Sketches, there: np.ndarray) -> np.ndarray:
        """For pairs of places here and there: the bits in which they differ, the longer one folded."""
        out = np.zeros(len(at), np.int64)
        kinds = self.size[at] << 32 | other.size[there]
        for kind in np.unique(kinds).tolist():
            m, n = kind >> 32, kind & 0xFFFFFFFF
            every = np.flatnonzero(kinds == kind)
            step = max(1, COMPARED // max(m, n))
            for lo in range(0, len(every), step):
                i = every[lo : lo + step]
                out[i] = np.bitwise_count(self._of(at[i], m, min(m, n)) ^ other._of(there[i], n, min(m, n))).sum(axis=1, dtype=np.int64)
        return out


def _admitted(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b, n) whose sketches differ in no more bits than similar sets may in shingles."""

    def run(batches):
        for batch in batches:
            rows = np.arange(len(batch))
            differ = Sketches(batch["x"]).differ(rows, Sketches(batch["y"]), rows)
            ok = (OF + SHARED) * differ <= (OF - SHARED) * (batch["s"].to_numpy().astype(np.int64) + batch["t"].to_numpy())
            yield batch.select(["a", "b", "n"]).filter(pa.array(ok))

    of = lambda node, x, s: nodes.select(F.col("node").alias(node), F.col("sketch").alias(x), F.col("size").alias(s))
    return pairs.join(of("a", "x", "s"), "a").join(of("b", "y", "t"), "b").select("a", "b", "n", "x", "y", "s", "t").mapInArrow(run, "a long, b long, n long")


def _pairs_between_parts(groups: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of a group's sets that are of different components and that sizes, places and sketches admit."""

    def run(batches):
        for batch in batches:
            found = [np.zeros((0, 2), np.int64)]
            held = batch["held"]
            cuts, flat = held.offsets.to_numpy(), held.flatten()
            node, size, at, part = (flat.field(c).to_numpy() for c in ("node", "size", "at", "part"))
            sketches, base = Sketches(flat.field("sketch")), cuts[0]
            size, at = size.astype(np.int64), at.astype(np.int64)
            for lo, hi in zip((cuts[:-1] - base).tolist(), (cuts[1:] - base).tolist(), strict=True):
                order = lo + np.argsort(node[lo:hi], kind="stable")
                s, rest, c = size[order], size[order] - at[order], part[order]
                step = max(1, TABLE // len(order))
                for first in range(0, len(order), step):
                    i = np.arange(first, min(len(order), first + step))[:, None]
                    x, y = np.nonzero((c[i] != c) & (i < np.arange(len(order))) & _may_share(s[i], s, rest[i], rest))
                    u, v = order[x + first], order[y]
                    ok = (OF + SHARED) * sketches.differ(u, sketches, v) <= (OF - SHARED) * (size[u] + size[v])
                    found.append(np.stack([node[u[ok]], node[v[ok]]], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        release()

    return groups.mapInArrow(run, "a long, b long").distinct()


def keep_first_of_near(docs: DataFrame, keep: list[str], words: int = WORDS) -> DataFrame:
    """The columns ``keep`` of the rows of ``docs`` (doc_id: long, text: string) that are first of their component.

    A component joins documents over links between texts whose sets of ``words``-word shingles have a Jaccard similarity
    of 0.8 or more; the smallest doc_id stays. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Texts without
    words, null too, are alike. Rows without an id stay, and link nothing; rows of one doc_id link what their texts link,
    and go together. Sets and shingles are told apart by 64-bit hashes, of which 48 bits travel with a set. All texts are
    exchanged once; later on, only those whose id falls on one of HASHES values in demand.
    """
    blocks, buckets = dealt(docs, ["doc_id", "text"])

    def name(batches):
        for batch in batches:
            texts = utf8(batch["text"])
            for lo, hi in passes(texts, STEP):
                sets = shingle_sets(texts[lo:hi], words)
                part = batch.slice(lo, hi - lo)
                cols = [part["doc_id"], part[BLOCK], pa.array(map(name_of, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(map(sketch, sets), pa.binary()), pa.array(map(set_print, sets), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", BLOCK, "node", "size", "sketch", "fp"])
        release()

    named = cut(blocks.where("doc_id is not null").select("doc_id", "text", BLOCK).mapInArrow(name, f"doc_id long, {BLOCK} int, node long, size int, sketch binary, fp long"))
    first = F.min(F.struct("doc_id", BLOCK)).alias("first")
    nodes = cut(named.groupBy("node").agg(first, F.any_value("size").alias("size"), F.any_value("sketch").alias("sketch"), F.any_value("fp").alias("fp")).select("node", "first.*", "size", "sketch", "fp"))

    rank_of = _ranks(docs.where("doc_id is not null"), words, max(1, nodes.count() // SAMPLE))
    held = docs.sparkSession.sparkContext.broadcast(rank_of)  # RANKED shingles at most

    def own_sets(table: pa.Table, ids: set[int], names: set[int]) -> dict[int, np.ndarray]:
        """The sets of the wanted documents of a block, by node."""
        doc_ids, texts = ids_and_texts(table)
        some = [t for i, t in zip(doc_ids.tolist(), texts, strict=True) if i in ids]
        found = {name_of(s): s for s in shingle_sets(some, words)}
        return {n: found[n] for n in sorted(names & found.keys())}

    def prefixes(table: pa.Table, chosen: pa.Table) -> tuple[np.ndarray, ...]:
        """Token, node, size and place of the prefix shingles of the sets that the block answers for."""
        known, rank = held.value
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))]
        for n, s in own_sets(in_order(table), set(chosen["doc_id"].to_pylist()), set(chosen["node"].to_pylist())).items():
            if not len(s):
                continue
            later = np.zeros(len(s), np.int64)
            if len(known):
                i = np.minimum(np.searchsorted(known, s), len(known) - 1)
                later = np.where(known[i] == s, rank[i], 0)
            head = s[np.argsort(later, kind="stable")][: len(s) + -SHARED * len(s) // OF + 1]
            parts.append((head, np.full(len(head), n, np.int64), np.full(len(head), len(s), np.int32), np.arange(len(head), dtype=np.int32)))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def distinct(token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct tokens, each token's place among them, and which ones two sets of the block share."""
        order = np.argsort(token, kind="stable")
        starts, run = runs_of(token[order])
        place = np.empty(len(order), np.int64)
        place[order] = run
        return token[order][starts], place, np.diff(np.append(starts, len(order))) > 1

    def ask(table: pa.Table, chosen: pa.Table) -> pa.Table:
        if not len(table) or not len(chosen):
            return ASK.empty_table()
        return asked(distinct(prefixes(table, chosen)[0])[0], table[BLOCK][0].as_py(), buckets)

    def entries_of(table: pa.Table, right: pa.Table) -> pa.Table:
        chosen = right.filter(pc.is_valid(right["node"]))
        if not len(table) or not len(chosen):
            return _ENTRY.empty_table()
        token, node, size, at = prefixes(table, chosen)
        tokens, place, shared = distinct(token)
        shared |= told(tokens, buckets, right.filter(pc.is_valid(right["bits"])))
        hit = shared[place]
        release()
        return pa.table([token[hit].view(np.int64), node[hit], size[hit], at[hit]], schema=_ENTRY)

    chosen = nodes.select(BLOCK, "doc_id", "node")
    asking = blocks.groupBy(BLOCK).cogroup(chosen.groupBy(BLOCK)).applyInArrow(ask, ddl(ASK))
    answers = asking.groupBy(BUCKET).applyInArrow(seen_twice, ddl(ANSWER))
    right = chosen.unionByName(answers.select(BLOCK, BUCKET, "bits"), allowMissingColumns=True)
    entries = cut(blocks.groupBy(BLOCK).cogroup(right.groupBy(BLOCK)).applyInArrow(entries_of, ddl(_ENTRY)))

    def ship(table: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(table) or not len(wanted):
            return _SHIP.empty_table()
        sets = own_sets(table, set(wanted["doc_id"].to_pylist()), set(wanted["node"].to_pylist()))
        return pa.table([wanted["a"], wanted["b"], wanted["salt"], pa.array([packed(sets[n], SENT) for n in wanted["node"].to_pylist()], pa.binary())], schema=_SHIP)

    def decide(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table.select(["a", "salt", "b"]), sort_keys=[("a", "ascending"), ("salt", "ascending"), ("b", "ascending")], null_placement="at_start"))
        hits, center = [], None
        for a, b, s in zip(*(table[c].to_pylist() for c in ("a", "b", "set")), strict=True):
            s = unpacked(s, SENT)
            if b is None:
                center = s
            elif (OF + SHARED) * len(np.intersect1d(center, s, assume_unique=True)) >= SHARED * (len(center) + len(s)):
                hits.append((a, b))
        release()
        return pa.table([[a for a, _ in hits], [b for _, b in hits]], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    hash_of = lambda c: F.pmod(F.xxhash64(c), F.lit(HASHES))
    in_demand = lambda f: F.broadcast(f.select(hash_of("doc_id").alias("hash")).distinct())  # noqa: E731  HASHES rows at most

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs whose sets reach the similarity: a set travels to each set that it is compared with, MEMBERS at most in one place."""
        pairs = pairs.select("a", "b")
        slices = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("slices"))
        home = nodes.select("node", BLOCK, "doc_id")
        b_side = pairs.join(slices, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int")).withColumn("node", F.col("b"))
        a_side = slices.select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("salt"), F.col("a").alias("node"))
        wanted = cut_short(b_side.select("a", "b", "salt", "node").unionByName(a_side).join(home, "node"))
        some = blocks.select("doc_id", "text", BLOCK).join(in_demand(wanted), hash_of("doc_id") == F.col("hash"), "left_semi")
        shipped = some.groupBy(BLOCK).cogroup(wanted.groupBy(BLOCK)).applyInArrow(ship, ddl(_SHIP))
        return shipped.groupBy(F.pmod(F.xxhash64("a", "salt"), F.lit(buckets))).applyInArrow(decide, "a long, b long")

    # every set of a shingle's group with the smallest one, and what SimHash proposes
    least = entries.groupBy("token").agg(F.min(F.struct("node", "size", "at")).alias("m"))
    stars = entries.join(least, "token").where(F.col("node") != F.col("m.node"))
    stars = stars.where(_may_share(F.col("size"), F.col("m.size"), F.col("size") - F.col("at"), F.col("m.size") - F.col("m.at"))).groupBy(F.col("m.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n"))
    prints = nodes.where("size > 0").select("node", "fp")
    by_print = cut(prints.groupBy("fp").agg(F.min("node").alias("node")))
    same = prints.join(by_print.select("fp", F.col("node").alias("a")), "fp").where("a <> node").select("a", F.col("node").alias("b"))
    close = link(by_print).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    proposed = stars.unionByName(same.unionByName(close).select("a", "b", F.lit(1 << 20).cast("long").alias("n")))
    stars = cut_short(_admitted(proposed.groupBy("a", "b").agg(F.max("n").alias("n")), nodes))
    best = cut_short(stars.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"))
    links = cut_short(verified(best))
    known = components(links)
    part = lambda node, name: known.select(F.col("node").alias(node), F.col("component").alias(name))
    others = stars.select("a", "b").join(best, ["a", "b"], "left_anti").join(part("a", "p"), "a", "left").join(part("b", "q"), "b", "left").where(F.coalesce("p", "a") != F.coalesce("q", "b"))
    # what the other stars join needs no pairs between its parts
    links = cut_short(links.unionByName(verified(others)))
    known = components(links)
    # groups of three and more whose sets are still apart
    rest = entries.join(known, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    apart = rest.groupBy("token").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).where("n > 2 and low <> high").select("token", "n", "low")
    # groups around one part hold the same pairs again and again: they meet in one task, so that it can tell
    slices = apart.groupBy("low").agg(F.ceil(F.sum("n") / TOGETHER).alias("slices"))
    placed = apart.join(slices, "low").select("token", "low", F.pmod(F.xxhash64("token"), F.col("slices")).alias("slice"))
    drawn = rest.join(placed, "token").join(nodes.select("node", "sketch"), "node").repartition(F.col("low"), F.col("slice"))
    groups = drawn.groupBy("low", "slice", "token").agg(F.collect_list(F.struct("node", "size", "at", "part", "sketch")).alias("held")).select("held")
    more = _pairs_between_parts(groups).join(stars, ["a", "b"], "left_anti")
    found = components(links.unionByName(verified(cut_short(more))))
    whole = cut(nodes.join(found, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("part")))
    smallest = whole.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    gone = cut_short(named.select("doc_id", "node").join(whole.select("node", "part").join(smallest, "part"), "node").where("doc_id <> component_id").select("doc_id").distinct())
    rows = docs.select(*dict.fromkeys([*keep, "doc_id"]))
    sure = rows.join(in_demand(gone), hash_of("doc_id") == F.col("hash"), "left_anti")
    doubtful = rows.join(in_demand(gone), hash_of("doc_id") == F.col("hash"), "left_semi").join(gone, "doc_id", "left_anti")
    return sure.select(keep).unionByName(doubtful.select(keep))


def _ranks(docs: DataFrame, words: int, modulus: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the texts finds frequent, sorted, and the rank of each: the most frequent one is last."""

    def split(batches):
        for batch in batches:
            texts = utf8(batch["text"])
            for lo, hi in passes(texts, STEP):
                tokens = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(texts[lo:hi], words)])
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64))], names=["token"])

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(modulus)) == 0).select("text").distinct().mapInArrow(split, "token long")
    often = [r[0] for r in sample.groupBy("token").count().where(F.col("count") >= LEAST).orderBy(F.desc("count"), "token").limit(RANKED).collect()]
    tokens = np.array(often, np.int64).view(np.uint64)
    order = np.argsort(tokens, kind="stable")
    return tokens[order], len(tokens) - order
