"""The trie against a loop over all prefixes."""

import hashlib
import random
import zlib

import pytest

from tonegrid.llm import tries
from tonegrid.llm.tries import build_trie, rebuild

SCHEMA = "conv_id long, turn int, role string, text string, depth int, name string"


def expected(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            key = f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(key).digest(), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(t, key=lambda x: x[:3])] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = (*own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h], *t[h:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        return [p, *(y for x in children.get(p, []) for y in below(x))]

    out = []
    for p, members in nodes.items():
        tree = below(p)
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in tree if x)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children.get(p, [])), sum(x not in children for x in tree), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(n, depth, seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), 100, 205, 299, 300, 301, 1000, -5, -100, 2**40]:
        for k in range(rng.choice([1, 2, 3, depth])):
            rows.append((c, rng.choice([k, k, k, None, 3]), rng.choice(["user", "assistant", None]) if k % 3 == 2 else "user", rng.choice(["", None, "é日𝕏", "yes", "a long text " * 3]) if k % 2 else "hello", 1, "x"))
    rows += [(None, 1, "user", "no id", 1, "x"), rows[5], rows[5], rows[9]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n, depth, ends", [(40, 5, 1024), (130, 9, 2), (12, 70, 1024)])
def test_trie(spark, monkeypatch, n, depth, ends):
    monkeypatch.setattr(tries, "ENDS", ends)
    rows = conversations(n, depth, n)
    rows += [(400 + k, 1, "user", "copy", 1, "x") for k in range(30)]
    got = build_trie(rebuild(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected(rows), key=repr)


def test_turnless_and_no_conversations(spark):
    absent = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1][:4]
    rows = [(c, 1, "user", "gone", 1, "x") for c in absent]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in build_trie(rebuild(frame)).collect()]
    assert got == expected(rows) == [(min(absent), 0, None, 4, 0, 1, 0, hashlib.sha256(",".join(map(str, absent)).encode()).hexdigest())]
    assert build_trie(rebuild(frame.limit(0))).count() == 0
    assert build_trie(rebuild(frame.withColumn("conv_id", frame.conv_id * 0).limit(1))).count() > 0


def test_names_are_as_many_as_turns(spark):
    """Over all cuts, each prefix is named once."""
    rows = [(c, k, "user", "same" if k < 40 else f"{c}", 1, "x") for c in (0, 1) for k in range(61)]
    sequences = rebuild(spark.createDataFrame(rows, SCHEMA))
    names = tries._prefixes(sequences, 6)
    assert names.count() == sequences.where("depth > 0").count() == names.select("conv_id", "depth").distinct().count()
    assert names.select("name").distinct().count() == 40 + 2 * 21
