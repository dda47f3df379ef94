"""Each operator against a brute-force version, an exact round trip or held-out accuracy, on small and awkward tables."""

import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonegrid.llm import embeddings, language, licenses, quality, rules, simhash, suffixes
from tonegrid.llm._vec import ALNUM, NOT_SPACE, PASS_BYTES, Words, covered
from tonegrid.llm.anchors import COVERS, drop_repeated_windows
from tonegrid.llm.components import components, local_roots
from tonegrid.llm.decontaminate import decontaminate
from tonegrid.llm.pieces import PieceCodec, encode_pieces
from tonegrid.llm.queries import public_tokenizer
from tonegrid.llm.token_files import EliasFano, WordCodec, read_tokens, write_tokens
from tonegrid.operators.lineage import shared_folder

SPACES = re.compile(r"[\x20\x09-\x0D]+")
ALNUMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string, __block string"


def low(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def corpus(n=60, seed=1):
    """Random texts over few words, with copies, near copies, nulls, empties, odd spaces and one long text."""
    rng = random.Random(seed)
    words = [w + c for w in ("the", "of", "Mit", "été", "日本", "x1", "a", "under", "license", "zz") for c in ("", ",", "s", "!!")]
    make = lambda k: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(k))
    texts = [None, "", "   ", "one", "\n\n", "word " * 300, make(3000)]
    texts += [make(rng.randint(1, 120)) for _ in range(n)]
    texts += [rng.choice(texts[7:]) for _ in range(12)]
    texts += [(t := rng.choice(texts[7:]))[: len(t) // 2] + "EDIT" + t[len(t) // 2 :] for _ in range(12)]
    texts += ["Released under the MIT License.\n" + make(20), "see Apache License, Version 2.0 " + make(9), make(5) + "\nWork is licensed under the gnu general public license version 3"]
    rng.shuffle(texts)
    return [(i, t, None if i % 7 == 0 else "en", None, None, "s", "clash", "b") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame([*rows, rows[10], rows[10], (None, "null id", *rows[0][2:]), (None, rows[12][1], *rows[0][2:])], SCHEMA).repartition(3)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_vector_words():
    texts = ["", "Ab  c\n", "été1 x", " "]
    for table, rx, lower in ((NOT_SPACE, SPACES, False), (ALNUM, ALNUMS, True)):
        w = Words([t.encode() for t in texts], table, lower)
        want = [[x for x in (rx.split(t) if rx is SPACES else rx.findall(low(t))) if x] for t in texts]
        assert w.count.tolist() == [len(x) for x in want]
        assert [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)] == [y for x in want for y in x]
    assert covered(np.array([1, 2]), 2, 6).tolist() == [False, True, True, True, False, False]


@pytest.mark.parametrize("period", [p for p in COVERS if p > 1])
def test_covers_hold_every_difference(period):
    assert {(a - b) % period for a in COVERS[period] for b in COVERS[period]} == set(range(period))


# --- 1 ---------------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark, docs):
    use = PieceCodec(public_tokenizer("piece_bpe_32k.model"))
    rng = random.Random(2)
    odd = ["", "   ", " a", "a  b \n\n c", "\n", "a\tb ﬁ①", "▁x▁▁y", "\0", "日本語 𝕏😀", "<s>", "x ", "q" * 500, "ab" * 60 + " ", *("".join(rng.choice("ab \n▁é日😀\t.0²") for _ in range(rng.randint(0, 14))) for _ in range(800))]
    odd += [None, "\1a \1\2 b", "c\1"]
    ids, ends = use.encode_batch(pa.array(odd))
    for text, own, decoded in zip(odd, np.split(ids, ends[:-1]), use.decode_batch(ids, ends), strict=True):
        want = use.library.encode(text or "", add_bos=True, add_eos=True)
        assert own.tolist() == want and use.decode(own.tobytes()) == use.library.decode(want) == decoded.decode()
    words = ["▁understanding", "a", "▁naïveté", "日本", "😀é", "aaaaaaa", "▁", "▁xyzzy", "ab" * 30]
    assert use.merge_all(words) == [np.array(use.merge(w), "<u4").tobytes() for w in words]
    for word in ("▁understanding", "a" * 90, "▁naïveté"):
        assert use.merge(word) == [i for i in use.library.encode("\n" + word if word[0] != "▁" else word[1:]) if use.library.id_to_piece(i) != "<0x0A>"][0 if word[0] == "▁" else 1 :]
    got = encode_pieces(docs, public_tokenizer("piece_bpe_32k.model"), ["doc_id", "text", "n_words"])
    assert got.count() == docs.count()
    for r in got.collect():
        ids = use.library.encode(r.text or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.piece_ids, r.decoded) == (len(ids), ids, use.library.decode(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert encode_pieces(docs.limit(0), public_tokenizer("piece_bpe_32k.model"), ["doc_id"]).count() == 0


def test_decode_of_any_ids():
    use = PieceCodec(public_tokenizer("piece_bpe_32k.model"))
    ids = [1, 259, 300, 200, 3, 5, 31000, 2]
    assert use.decode(np.array(ids, "<u4").tobytes()) == use.library.decode(ids)


# --- 2 ---------------------------------------------------------------------------------------------------------------


def language_rows(n=300):
    rng = random.Random(3)
    stock = {"en": "the thing with that whole shore", "de": "der schnee und dass ich gehe", "fr": "le monde est une école où", "es": "el niño que está en la ciudad"}
    rows = []
    for i in range(n):
        lang = rng.choice(list(stock))
        rows.append((i, " ".join(rng.choice(stock[lang].split()) for _ in range(rng.randint(4, 60))), lang))
    return [*rows, (n, None, "en"), (n + 1, "", None), (n + 2, "123 !?", "de"), (n + 3, "×÷ 日本", None)]


def test_language(spark):
    docs = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language.fit_language(docs, ~held, 50)
    assert [f for f, _ in model.families] == ["germanic", "romance"]
    twice = docs.unionByName(docs.where("doc_id in (5, 300)"))
    again = [r.lang_pred for i in (5, 300) for r in language.identify(twice, model, ["doc_id"]).where(f"doc_id = {i}").collect()]
    assert len(again) == 4 and again[0] == again[1] and again[2:] == ["und", "und"]
    got = {r.doc_id: r for r in language.identify(docs.withColumn("held", held), model, ["doc_id", "lang", "held", "score"]).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([r.lang_pred == r.lang for r in got.values() if r.held and r.doc_id < 300]) > 0.97
    assert [got[300 + k].lang_pred for k in range(3)] == ["und"] * 3 and got[303].lang_pred != "und"
    nothing = language.fit_language(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.identify(docs, nothing, ["doc_id"]).collect()} == {"und"}


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "COPIED", 100_000)  # machines in several steps
    rng = random.Random(8)
    names = [f"l{k:02}" for k in range(68)]
    words = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3)] for k in names}
    rows = [(len(names) * n + i, " ".join(rng.choice(words[k]) for _ in range(12)), k) for n in range(3) for i, k in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    model = language.fit_language(docs, F.lit(True))
    assert sorted(k for _, m in model.families for k in m) == names
    assert all(r.lang_pred == r.lang for r in language.identify(docs, model, ["lang"]).collect())


# --- 3 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("many", [10**9, 20])
def test_embeddings_against_all_pairs(spark, monkeypatch, many):
    monkeypatch.setattr(embeddings, "TILE", 16)
    monkeypatch.setattr(embeddings, "MANY", many)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(25, 12))
    rows = []
    for i in range(150):
        v = base[i % 25] + rng.normal(size=12) * rng.choice([0.0, 0.02, 0.12])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1.0, 3.0])], int(i % 25 % 3)))
    odd = [(200, None, 1), (201, [0.0] * 12, 1), (202, [None, *[1.0] * 11], 1), (203, [math.nan, *[1.0] * 11], 1), (204, rows[0][1], None), (205, [1.0, 2.0], 1), (206, [2.0, 4.0], 1), (207, [math.inf, *[1.0] * 11], 0), (208, [], 0), (None, rows[3][1], rows[3][2])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(5)
    good = rows + [odd[5], odd[6], odd[9]]
    x = [np.array(np.float32(v), float) for _, v, _ in good]
    near = np.array([[i != j and len(a) == len(b) and good[i][2] == good[j][2] and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98 for j, b in enumerate(x)] for i, a in enumerate(x)])
    root = local_roots(len(x), *np.nonzero(near))
    ids = [g[0] for g in good]
    least = {r: min(i for i, q in zip(ids, root, strict=True) if q == r and i is not None) for r in set(root)}
    want = {i: (int(near[k].sum()), least[root[k]]) for k, i in enumerate(ids)}
    want |= {o[0]: (0, o[0]) for o in odd[:5] + odd[7:9]}
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(table).collect()}
    assert got == want and near.sum() > 100
    assert embeddings.near_vectors(table.limit(0)).count() == 0
    assert embeddings.near_vectors(table.where("vec_id = 201")).first().kept


@pytest.mark.parametrize("turned", [4_000_000, 200])
def test_vectors_of_many_sizes(spark, monkeypatch, turned):
    monkeypatch.setattr(embeddings, "TURNED", turned)
    rows = [(3 * n + k, [float(i % 5 + 1) * (1 + k) for i in range(n)] if k < 2 else [float(i == 0) for i in range(n)], 1) for n in range(2, 72) for k in range(3)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    cosine = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    want = {(i, sum(i != j and len(a) == len(b) and cosine(a, b) >= 0.98 for j, b, _ in rows)) for i, a, _ in rows}
    assert {(r.vec_id, r.n_links) for r in got} == want and all(r.component_id == r.vec_id - (r.vec_id % 3 == 1) for r in got)


def test_reach_stops_early_but_exactly():
    rng = np.random.default_rng(0)
    a, b = (rng.normal(size=(90, 40)) for _ in range(2))
    b[:40] = a[:40] + rng.normal(size=(40, 40)) * 0.05
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    i, j = embeddings.reach(unit(a), unit(b), a, b, 0.98)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(unit(a) @ unit(b).T >= 0.98)), strict=True))


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(7, 7), (None, 3), (500, 501), (500, 501)]
    links = spark.createDataFrame(pairs, "a long, b long")
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    nodes = sorted({x for p in real for x in p})
    at = {x: k for k, x in enumerate(nodes)}
    root = local_roots(len(nodes), np.array([at[a] for a, _ in real]), np.array([at[b] for _, b in real]))
    assert {r.node: r.component for r in components(links).collect()} == {x: nodes[r] for x, r in zip(nodes, root, strict=True)}
    assert components(links.limit(0)).count() == 0


def test_components_of_a_short_table_run_in_few_tasks(spark):
    """Where tasks are many, as for a large corpus, each round of some links would write files for all of them (pipeline)."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    folder = Path(re.sub("^file:/*", "/", spark.sparkContext._jsc.sc().getCheckpointDir().get()))
    parts = lambda: {str(p) for p in folder.rglob("part-*") if p.suffix != ".crc"}
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        old = parts()
        assert {r.component for r in components(links).collect()} == {0}
        assert 64 <= len(parts() - old) < 2 * 64
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_folder_that_a_cluster_must_name():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: Cluster)

    Cluster.getCheckpointDir = staticmethod(lambda: Cluster)
    Cluster.isDefined = staticmethod(lambda: False)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Cluster)


# --- 4 ---------------------------------------------------------------------------------------------------------------


def brute_print(text, n=3):
    import xxhash

    w = [x for x in SPACES.split(low(text)) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + n]).encode(), 42) for k in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [brute_print(t) for _, t in rows]
    f = np.array(prints, np.uint64)
    root = local_roots(len(f), *np.nonzero(np.bitwise_count(f[:, None] ^ f[None]) <= 2))
    least = {r: min((i for (i, _), q in zip(rows, root, strict=True) if q == r and i is not None), default=None) for r in set(root)}
    want = sorted(((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, root, strict=True)), key=repr)
    assert collected(simhash.near_duplicates(docs)) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("group", [2048, 4])
def test_links_join_all_within_reach(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(6)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:60]:
        for _ in range(4):
            prints.add(p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64) if rng.random() < 0.3 else 0))
    prints = sorted(prints)
    f = np.array(prints, np.uint64)
    root = local_roots(len(f), *np.nonzero(np.bitwise_count(f[:, None] ^ f[None]) <= 2))
    nodes = spark.createDataFrame([(i, int(np.int64(np.uint64(p).view(np.int64)))) for i, p in enumerate(prints)], "node long, fp long")
    got = {r.node: r.component for r in components(simhash.link(nodes)).collect()}
    assert [got.get(i, i) for i in range(len(f))] == root.tolist()


@pytest.mark.parametrize("bits", [2, 3])
def test_chains_prune_before_the_full_check(spark, bits):
    """Of one group, the pairs that reach the full check are those whose chain keeps its budgets, far fewer than all."""
    rng = random.Random(8)
    ring = simhash._segments(bits)
    n = len(ring)
    head = rng.getrandbits(64) & ((1 << ring[2][0]) - 1)  # segments 0 and 1 agree
    prints = {head | (rng.getrandbits(64) >> ring[2][0] << ring[2][0]) for _ in range(500)}
    prints |= {p ^ (1 << rng.randrange(ring[2][0], 64)) ^ (1 << rng.randrange(ring[2][0], 64)) for p in list(prints)}
    fps = np.array(sorted(prints), np.uint64)
    part = lambda k: (fps >> np.uint64(ring[k][0])) & np.uint64((1 << ring[k][1]) - 1)
    parts, budgets = np.stack([part(k) for k in range(2, n)], axis=1), [(k + 1) * bits // n for k in range(2, n)]
    order = np.lexsort(parts.T[::-1])
    left, right = simhash._chained(np.zeros(len(fps), np.int64), parts[order], budgets)
    got = {tuple(sorted((a, b))) for a, b in zip(order[left].tolist(), order[right].tolist(), strict=True) if a != b}
    sums = np.cumsum([np.bitwise_count(p[:, None] ^ p[None]) for p in parts.T], axis=0)
    want = np.triu((sums <= np.array(budgets)[:, None, None]).all(axis=0), 1)
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(want)), strict=True))
    assert len(left) - len(fps) == len(got) and 50 < len(got) < len(fps) ** 2 / 200


def test_null_ids_link_what_they_stand_between(spark):
    docs = spark.createDataFrame([(1, "zero"), (2, "far"), (None, "between"), (7, "alone")], "doc_id long, text string")
    prints = {"zero": 0, "between": 0b11, "far": 0b1111, "alone": 1 << 40 | 0b111111111}
    given = docs.withColumn("fp", F.create_map(*(F.lit(x) for p in prints.items() for x in p))[F.col("text")].cast("long")).select("doc_id", "fp")
    original, simhash.fingerprints = simhash.fingerprints, lambda *_: given
    try:
        got = {r.fingerprint: r.component_id for r in simhash.near_duplicates(docs).collect()}
    finally:
        simhash.fingerprints = original
    assert got == {f"{p:016x}": 7 if t == "alone" else 1 for t, p in prints.items()}


# --- 5 ---------------------------------------------------------------------------------------------------------------


def test_licenses(spark, docs):
    got = {(r.doc_id, r.text): tuple(r)[2:] for r in licenses.scan_licenses(docs, ["doc_id", "text", "n_words", "score"]).collect()}
    for r in docs.collect():
        w, starts, base = ALNUMS.findall(low(r.text)), [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    starts.append(k)
                    base.add(label)
        labels, sure, score = set(base), set(base), 0.0
        for label, tokens, n, marks in licenses.template_tokens():
            for k in range(0, len(w), n):
                held = set(w[k : k + 2 * n])
                share = len(held & set(tokens)) / len(tokens)
                if share >= licenses.THRESHOLD:
                    labels.add(label)
                    sure |= {label} if held >= set(marks) else set()
                    score = max(score, share)
        want = (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), ",".join(sorted(labels - sure)), 1.0 if base else score)
        assert got[r.doc_id, r.text] == want
    assert {x for v in got.values() for x in v[5].split(",")} >= {"mit", "apache-2", "gpl-3"}
    assert licenses.scan_licenses(docs.limit(0), ["doc_id"]).count() == 0


def test_wrapped_and_other_notices(spark):
    rows = [
        (1, "noise\nRedistribution and use in source\n * and binary forms, with or without\n * modification, are permitted"), (2, "Released under the Apache License"),
        (3, "Subject to the terms of the Mozilla Public\nLicense, version 2.0"), (4, "Licensed under CC BY-SA 4.0"), (5, "license " * 50 + "released " * 50 + "under " * 50 + "mit " * 50 + "the " * 50),
        (6, " ".join(f"w{i}" for i in range(7)) + " Released under\nthe MIT License" + " end" * 9),
        (7, "Licensed under the Foo License, Version 2.0"), (8, "Licensed under the Foo License, Version 2.0 or the Apache License, Version 2.0, licensed under either"),
    ]
    got = {r.doc_id: (r.labels, r.doubtful_labels, r.n_base) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got == {
        1: ("bsd-3", "", 0), 2: ("mit", "mit", 0), 3: ("mpl-2", "", 0), 4: ("cc-by-nc,cc-by-sa", "cc-by-nc", 0), 5: ("", "", 0), 6: ("mit", "", 1), 7: ("apache-2", "apache-2", 0), 8: ("apache-2", "", 1),
    }


def test_license_phrases_back_to_back(spark):
    d = spark.createDataFrame([(1, "Under the MIT license under the mit LICENSE, mit"), (2, "K under the mit licenses")], "doc_id long, text string")
    a, b = licenses.scan_licenses(d, ["doc_id"]).orderBy("doc_id").collect()
    assert (a.n_base, a.first_word, a.last_word, a.n_words) == (2, 0, 4, 9) and (b.n_base, b.base_labels) == (0, "")


# --- 6 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("part_bytes", [10**9, 60])
def test_decontamination(spark, docs, part_bytes):
    texts = [r.text for r in docs.collect() if r.text]
    long = max(texts, key=len)
    items = [(1, " ".join(ALNUMS.findall(long)[40:70])), (2, "nothing of this occurs anywhere in these odd texts so no window of it can hit"), (3, "UNDER the"), (4, None), (5, " .. "), (None, texts[5][:90]), (10, "zz"), (1, "second row of the same item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = ALNUMS.findall(low(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("null" if i is None else str(i))
    got = collected(decontaminate(docs, bench, ["doc_id", "text", "n_words"], part_bytes=part_bytes))
    want = []
    for r in docs.collect():
        w = ALNUMS.findall(low(r.text))
        hit, held = [False] * len(w), set()
        for p, ids in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    held |= ids
                    hit[k : k + len(p)] = [True] * len(p)
        want.append((r.doc_id, r.text, len(w), sum(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    assert got == sorted(want, key=repr)
    assert decontaminate(docs.limit(0), bench, ["doc_id"]).count() == 0
    assert decontaminate(docs, bench.limit(0), ["doc_id"]).where("contaminated").count() == 0


# --- 7 ---------------------------------------------------------------------------------------------------------------


def test_elias_fano():
    rng = np.random.default_rng(7)
    for n, top in ((1, 0), (1, 9), (400, 100), (1000, 10**9), (300, 2**62)):
        v = np.sort(rng.integers(0, top + 1, n))
        e = EliasFano.of(v)
        assert (e.select(np.arange(n)) == v.astype(np.uint64)).all()
        assert (e.select(np.array([n - 1, 0])) == v[[n - 1, 0]].astype(np.uint64)).all()
    assert len(EliasFano.of(np.zeros(0, int)).select(np.zeros(0, int))) == 0


def test_word_codec_equals_the_library():
    use = WordCodec(public_tokenizer("word_bpe_49k.json"))
    rng = random.Random(8)
    marks = [*"abS's'tLl dÉéßŸÿ×÷'09!.*|<>İıſŉ日  Σς", "'re", "'ve", "<|endoftext|>", "́", "\x1c"]
    assert use.plain
    for _ in range(1200):
        t = "".join(rng.choice(marks) for _ in range(rng.randint(0, 12)))
        assert use.encode(pa.array([t]))[0].tolist() == use.library.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files(spark, docs, tmp_path):
    write_tokens(docs, str(tmp_path / "t"), public_tokenizer("word_bpe_49k.json"), 2)
    got = read_tokens(spark, str(tmp_path / "t")).collect()
    library = WordCodec(public_tokenizer("word_bpe_49k.json")).library
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [i for i, _ in rows]
    place, texts = 0, {}
    for i, t in rows:
        texts.setdefault(i, []).append([*library.encode(t, add_special_tokens=False).ids, 2])
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == place and r.ids in texts[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        place += r.n_tokens
    write_tokens(docs.limit(0), str(tmp_path / "e"), public_tokenizer("word_bpe_49k.json"), 2)
    assert read_tokens(spark, str(tmp_path / "e")).count() == 0


# --- 8 ---------------------------------------------------------------------------------------------------------------


def test_quality(spark):
    rng = random.Random(9)
    plain = [w for w in "thing of the whole moor with sand and light in that open land".split()]
    rows, labels = [], []
    for i in range(700):
        good = rng.random() < 0.7
        text = " ".join(rng.choice(plain) + ("" if good else rng.choice(["###", "$$$", "!!"])) for _ in range(rng.randint(5, 80)))
        rows.append((i, text))
        labels += [(i, int(good))] * (1 + i % 50 // 49)
    rows += [(900, None), (901, ""), (902, "   ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (None, 1), (5000, 0), (3, None)], "doc_id long, quality int")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = quality.fit_quality(docs, marks, ~held)
    got = {r.doc_id: r for r in quality.score_quality(docs.withColumn("held", held), model, ["doc_id", "held"]).collect()}
    for i in (4, 901):
        assert [r.score for r in quality.score_quality(docs.unionByName(docs), model, ["doc_id"]).where(f"doc_id = {i}").collect()] == [got[i].score] * 2
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    truth = dict(labels)
    assert np.mean([(got[i].score > 0.5) == bool(truth[i]) for i in truth if got[i].held]) > 0.95
    for few in (marks.limit(0), marks.where("quality = 1")):
        flat = quality.fit_quality(docs, few, F.lit(True))
        assert len({r.score for r in quality.score_quality(docs, flat, ["doc_id"]).collect()}) == 1
    assert quality.score_quality(docs.limit(0), model, ["doc_id"]).count() == 0


def test_temperature_flattens_overconfidence():
    rng = np.random.default_rng(1)
    y = (rng.random(2000) < 0.7).astype(float)
    assert quality.calibrate(np.where(y > 0, 1, -1) * np.where(rng.random(2000) < 0.8, 6.0, -6.0), y) > 2


# --- 9 ---------------------------------------------------------------------------------------------------------------


def repeats_by_brute_force(rows, length, keep_first):
    seen, first = {}, {}
    for n, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            seen[s] = seen.get(s, 0) + 1
            first.setdefault(s, (n, k))
    want = []
    for n, (i, t) in enumerate(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if seen[s] > 1 and not (keep_first and first[s] == (n, k)):
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(want, key=lambda w: repr((*w[:5], bytearray(w[5]))))


def thue_morse(n, letters="ab"):
    """Such a string and its complement defeat polynomial hashes modulo 2**64."""
    return "".join(letters[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("hot", [512, 1])
@pytest.mark.parametrize("keep_first", [False, True])
def test_repeats(spark, docs, monkeypatch, hot, keep_first):
    monkeypatch.setattr(suffixes, "HOT", hot)
    length = 60
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    got = collected(suffixes.mark_repeats(docs, ["doc_id"], length, keep_first))
    assert [(*g[:5], bytes(g[5])) for g in got] == repeats_by_brute_force(rows, length, keep_first)
    assert suffixes.mark_repeats(docs.limit(0), ["doc_id"], length).count() == 0


@pytest.mark.parametrize("hot", [512, 1])
def test_repeats_of_strings_that_defeat_polynomial_hashes(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(4)
    noise = lambda: "".join(rng.choice("cdefgh") for _ in range(500))
    texts = [noise() + thue_morse(n, x) + noise() for n in (256, 512, 1024, 2048, 4096) for x in ("ab", "ba")]
    texts += [thue_morse(512, "xy") + texts[0][:450], thue_morse(512, "yx") + texts[0][:450]]
    rows = list(enumerate(texts))
    got = collected(suffixes.mark_repeats(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], 400, False))
    assert [(*g[:5], bytes(g[5])) for g in got] == repeats_by_brute_force(rows, 400, False)


def test_longest_previous_factors():
    rng = random.Random(10)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(400)), np.uint8)
    depth = 40
    starts = np.arange(len(data) - depth + 1)
    order, lcp = suffixes.suffix_order(data, starts, depth)
    raw = data.tobytes()
    part = [raw[i : i + depth] for i in starts]
    assert [part[i] for i in order] == sorted(part)
    common = lambda i, j: next((k for k in range(depth) if raw[i + k] != raw[j + k]), depth)
    assert lcp[1:].tolist() == [common(a, b) for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)]
    length, source = suffixes.longest_previous(order, lcp, 1)
    for i in starts.tolist():
        best = max((common(i, j) for j in range(i)), default=0)
        assert length[i] == best and (best == 0 or (source[i] < i and common(i, source[i]) == best))


# --- 10 --------------------------------------------------------------------------------------------------------------


def without(text, gone):
    """Removed words go with the space behind them, or before them at the end of the text."""
    if not any(gone):
        return text
    pieces = re.findall(r"([^\x20\x09-\x0D]+)([\x20\x09-\x0D]*)", text)
    lead = text[: re.search(r"[^\x20\x09-\x0D]", text).start()]
    last = max((k for k, g in enumerate(gone) if not g), default=None)
    if last is None:
        return pieces[-1][1]
    out = lead + "".join(a + b for k, (a, b) in enumerate(pieces) if not gone[k] and k < last) + pieces[last][0]
    return out + (pieces[-1][1] if last < len(pieces) - 1 else pieces[last][1])


@pytest.mark.parametrize("window", [2, 5, 13, 30])
def test_repeated_windows(spark, docs, window):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    cut = lambda t: [x for x in SPACES.split(t or "") if x]
    least = {}
    for i, t in rows:
        w = cut(t)
        for k in range(len(w) - window + 1):
            least.setdefault(tuple(w[k : k + window]), math.inf if i is None else i)
    want = []
    for i, t in rows:
        w = cut(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < (math.inf if i is None else i):
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i, without(t, gone), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert collected(drop_repeated_windows(docs, ["doc_id", "text", "n_words"], window)) == sorted(want, key=repr)
    assert drop_repeated_windows(docs.limit(0), ["doc_id", "text"], window).count() == 0


def test_words_that_defeat_polynomial_hashes(spark):
    rows = []
    for k, n in enumerate((64, 512, 1024, 2048, 4096)):
        line = [f"w{k}x{i}" for i in range(12)]
        for x in ("ab", "ba", "ab"):
            rows.append((len(rows), " ".join([*line[:6], thue_morse(n, x), *line[6:]])))
    got = drop_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).select("doc_id", "n_removed")
    assert collected(got) == [(i, 13 if i % 3 == 2 else 0) for i in sorted(range(len(rows)), key=lambda i: repr((i,)))]


# --- all -------------------------------------------------------------------------------------------------------------


def test_texts_longer_than_a_pass(spark):
    """Two texts of over 2 MB, one of them twice, beside short ones: every operator takes them whole."""
    rng = random.Random(21)
    stock = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    long = " ".join(rng.choice(stock) for _ in range(380_000)) + "\nunder the MIT license"
    other = "Under The MIT license\n" + " ".join(rng.choice(stock) for _ in range(380_000))
    rows = [(1, long), (2, "short text"), (3, long), (4, other), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert len(long) > PASS_BYTES
    words = {i: (t or "").split() for i, t in rows}
    use = PieceCodec(public_tokenizer("piece_bpe_32k.model"))
    for r in encode_pieces(docs, public_tokenizer("piece_bpe_32k.model"), ["doc_id"], ids=False, decoded=False).collect():
        assert r.n_tokens == len(use.library.encode(dict(rows)[r.doc_id] or "", add_bos=True, add_eos=True))
    assert language.identify(docs, language.fit_language(docs.withColumn("lang", F.lit("en")), F.lit(True)), ["doc_id"]).where("lang_pred = 'en'").count() == 4
    prints = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(docs).collect()}
    assert prints[1] == prints[3] != prints[4] and prints[4] == f"{simhash.fingerprint(other.encode()):016x}"
    licensed = {r.doc_id: (r.n_words, r.first_word, r.last_word) for r in licenses.scan_licenses(docs, ["doc_id"]).collect()}
    assert licensed[1] == (380_004, 380_000, 380_000) and licensed[4] == (380_004, 0, 0) and licensed[5] == (0, None, None)
    bench = spark.createDataFrame([("x", " ".join(words[4][-13:])), ("y", other)], "item_id string, text string")
    hits = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate(docs, bench, ["doc_id"]).collect()}
    assert hits[4] == (380_004, 2) and hits[2] == (0, 0)
    path = f"{shared_folder(spark)}/long-tokens"
    write_tokens(docs, path, public_tokenizer("word_bpe_49k.json"), 2)
    library = WordCodec(public_tokenizer("word_bpe_49k.json")).library
    for r in read_tokens(spark, path).collect():
        assert r.ids == [*library.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids, 2]
    repeats = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixes.mark_repeats(docs, ["doc_id"], 400, False, digest=True).collect()}
    assert repeats == {1: (len(long),) * 2, 2: (10, 0), 3: (len(long),) * 2, 4: (len(other), 0), 5: (0, 0)}
    removed = {r.doc_id: r.n_removed for r in drop_repeated_windows(docs, ["doc_id"], digest=True).collect()}
    assert removed == {1: 0, 2: 0, 3: len(words[3]), 4: 0, 5: 0}
    model = quality.fit_quality(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), F.lit(True))
    scores = {r.doc_id: r.score for r in quality.score_quality(docs, model, ["doc_id"]).collect()}
    assert scores[1] == scores[3] and all(0 <= x <= 1 for x in scores.values())


def test_columns_with_the_names_of_helpers(spark):
    """What a user's table holds under names that the operators use themselves comes through."""
    names = ["__block", "__bucket", "__row", "__size", "__words", "__low", "__text", "__base", "__met", "__sure", "hit_words", "hit_items", "kept_0", "spaced", "own"]
    twice = " ".join(f"w{i}" for i in range(40)) + " under the MIT license"
    rows = [(i, t, *(f"{n} {i}" for n in names)) for i, t in enumerate([twice, "short", twice, None, "x " + twice])]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{n}` string" for n in names)]))
    bench = spark.createDataFrame([(i, twice[i * 4 :]) for i in range(4)] * 300, "item_id long, text string")
    want = sorted((r[0], *r[2:]) for r in rows)
    keep = ["doc_id", *names]
    found = [
        licenses.scan_licenses(docs, keep), decontaminate(docs, bench, keep), decontaminate(docs, bench, keep, part_bytes=200), suffixes.mark_repeats(docs, keep, 100, digest=True),
        drop_repeated_windows(docs, keep, digest=True), drop_repeated_windows(docs, [*keep, "text"]).drop("text"), rules.apply_rules(docs, keep),
    ]
    for f in found:
        assert f.columns[: len(keep)] == keep
        assert sorted(tuple(r) for r in f.select(keep).collect()) == want
