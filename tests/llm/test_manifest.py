"""The manifest against a loop that hashes level by level; ranks against sorting."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tonegrid.llm import manifest
from tonegrid.llm._ranks import ranked
from tonegrid.llm.manifest import build_manifest, fold_proof

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, node int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climbed(leaves):
    """The top of a list of digests and for each of them its proof."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(at):
            other = i ^ 1
            proofs[k].append(("right" if other > i else "left", level[other]) if other < len(level) else (None, None))
            at[k] = i // 2
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0], proofs


def expected(rows):
    groups, out = {}, []
    for r in rows:
        h = sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[1], r[2], r[3], r[4])))
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, h, r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climbed([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, above = climbed([trees[g][0] for g in order])
    for g, up in zip(order, above, strict=True):
        for (_, _, h, r), proof in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            out.append((r[0], r[6], h, trees[g][0], root, [*proof, *up]))
    return out


@pytest.mark.parametrize("span, n", [(8, 70), (2, 70), (1, 9), (3, 600)])
def test_manifest(spark, monkeypatch, span, n):
    monkeypatch.setattr(manifest, "SPAN", span)
    rng = random.Random(n)
    rows = [(i, rng.choice(["a", None, "é:"]), rng.choice([None, "en", "en", "en", "fr", "", "日本"]), rng.choice([None, i]), rng.choice([None, "", "text " * i]), "clash", 7) for i in range(n)]
    rows += [(n, "s", "lone", 1, "t", "", 1), *[(None, None, "en", None, None, "", 7)] * 3, *[rows[3]] * 2, (rows[4][0], *rows[4][1:4], "same id", "", 7)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = build_manifest(docs, FIELDS, "lang", "doc_id", keep=["doc_id", "leaf", "node"])
    assert got.columns == ["doc_id", "node", "leaf", "subroot", "root", "proof"]
    assert sorted((tuple([*r[:5], [tuple(s) for s in r.proof]]) for r in got.collect()), key=repr) == sorted(expected(rows), key=repr)
    assert got.where(fold_proof(F.col("leaf"), F.col("proof")) == F.col("root")).count() == len(rows)
    assert got.where(fold_proof(F.lit("0" * 64), F.col("proof")) == F.col("root")).count() == 0


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, "s", None, 2, "t", "", 0)], SCHEMA)
    (row,) = build_manifest(docs, FIELDS, "lang", "doc_id", keep=[]).collect()
    assert row.leaf == row.subroot == row.root == sha("1:11:s-1:21:t") and row.proof == []
    assert build_manifest(docs.limit(0), FIELDS, "lang", "doc_id", keep=["doc_id"]).count() == 0


def test_ranks_of_groups_over_many_partitions(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "hot", "hot", "hot", "z"]), rng.choice([None, *range(9)])) for _ in range(3000)] + [("only", 1)]
    frame = spark.createDataFrame(rows, "g string, k int").repartition(7)
    got = [tuple(r) for r in ranked(frame, "g", ["k"]).collect()]
    want, seen = [], {}
    for g, k in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)):
        want.append((g, k, seen.setdefault(g, 0)))
        seen[g] += 1
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert ranked(frame.limit(0), "g", ["k"]).count() == 0
