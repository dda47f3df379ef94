"""Language identification by hierarchical discrimination.

A text's family comes first, then one-versus-one linear support vector machines separate the languages of that family;
most votes win. All machines see the same features: relative frequencies of hashed byte trigrams of the letters.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrid.llm._vec import LOWER, flatten, passes, rows, utf8

#: Families of closely related languages; any other language is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "uk"),
}
#: Features, and the documented bound of the training sample: about so many texts of each language.
FEATURES, PER_LANGUAGE = 4096, 800
#: Weights that one vectorised step of a prediction copies, beyond those of one machine.
COPIED = 32_000_000
UNDETERMINED = "und"

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature of each byte place, and where each text starts; the number of places with a letter in each text."""
    data, start, _ = flatten(texts, b"  ")
    data = LOWER[data]
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[capital] += 0x20  # accented capitals of Latin-1
    data = _LETTERS[data].astype(np.uint32)
    code = np.empty(len(data), np.uint32)
    code[:-2] = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    code[-2:] = 0x202020
    blank = code == 0x202020
    feature = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    feature[blank] = FEATURES
    return feature, start, np.add.reduceat((~blank).astype(np.int64), start) if len(texts) else np.zeros(0, np.int64)


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode(errors="replace"))


def margin_machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine with squared hinge loss, by accelerated descent. y: +1 or -1."""
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)  # both sides weigh alike
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    vw, vb = w.copy(), b
    rate = np.float32(1.0 / (1.0 + 2 * cost * (1 + np.einsum("ij,ij->i", x, x).max())))
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ vw + vb)) * y * share
        nw, nb = vw - rate * (vw - 2 * np.float32(cost) * (slack @ x)), vb + rate * 2 * np.float32(cost) * slack.sum()
        push = np.float32(k / (k + 3))
        vw, vb = nw + push * (nw - w), nb + push * (nb - b)
        w, b = nw, nb
    return w, float(b)


@dataclass
class LanguageModel:
    """Machines between families and between the languages of each; weights by feature, the last row for no letters."""

    families: list[tuple[str, list[str]]]
    machines: list[tuple[str, str]]  # the sides (positive, negative) of each column
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        feature, start, letters = trigrams(texts)
        step = max(1, COPIED // max(1, len(feature)))
        parts = [np.add.reduceat(self.weights[:, i : i + step][feature], start, axis=0) for i in range(0, len(self.bias), step)] if len(texts) else []
        total = np.concatenate(parts, axis=1) if parts else np.zeros((len(texts), len(self.bias)))
        margin = total / np.maximum(letters, 1)[:, None] + self.bias
        names, scores = [], []
        for text, m, n in zip(texts, margin, letters, strict=True):
            if not n or not has_letter(text):
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            family, p = self._vote([f for f, _ in self.families], m)
            language, q = self._vote(dict(self.families)[family], m)
            names.append(language)
            scores.append(p * q)
        return names, np.array(scores, np.float64)

    def _vote(self, sides: list[str], margin: np.ndarray) -> tuple[str, float]:
        if len(sides) == 1:
            return sides[0], 1.0
        votes = {s: [0, 0.0] for s in sides}
        for k, (p, q) in enumerate(self.machines):
            if p in votes and q in votes:
                votes[p][0] += margin[k] > 0
                votes[q][0] += margin[k] <= 0
                votes[p][1] += margin[k]
                votes[q][1] -= margin[k]
        best = max(sides, key=lambda s: (*votes[s], s))
        return best, float(1 / (1 + np.exp(-4 * votes[best][1] / (len(sides) - 1))))


def fit_language(docs: DataFrame, chosen: Column, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learns from texts and non-null langs of about ``per_language`` rows of each language, dealt by a hash of doc_id.

    Every language is learned; the sample grows with their number, the machines with its square.
    """
    rows_ = docs.where(chosen & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNDETERMINED))
    counts = {r[0]: r[1] for r in rows_.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return LanguageModel([(UNDETERMINED, [UNDETERMINED])], [], np.zeros((FEATURES + 1, 0)), np.zeros(0))
    unit = 1 << 40
    shares = docs.sparkSession.createDataFrame([(k, min(unit, unit * per_language // n)) for k, n in counts.items()], "lang string, __share long")
    sample = rows_.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(unit)) < F.col("__share")).select("lang", "text")

    def run(batches):
        for batch in batches:
            texts = utf8(batch["text"])
            for lo, hi in passes(texts):
                feature, start, letters = trigrams(texts[lo:hi])
                ends = np.append(start[1:], len(feature))
                vectors = [(np.bincount(feature[a:b], minlength=FEATURES + 1)[:FEATURES] / max(1, n)).astype(np.float32) for a, b, n in zip(start, ends, letters, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["lang"].slice(lo, hi - lo), pa.array([v.tobytes() for v in vectors])], names=["lang", "x"])

    found = sorted((r[0], r[1]) for r in sample.mapInArrow(run, "lang string, x binary").collect())  # the bounded sample
    x = np.stack([np.frombuffer(v, np.float32) for _, v in found]) if found else np.zeros((0, FEATURES), np.float32)
    lang = np.array([k for k, _ in found])
    languages = sorted(set(lang.tolist())) or sorted(counts)
    family_of = {k: f for f, members in FAMILIES.items() for k in members}
    by_family = defaultdict(list)
    for k in languages:
        by_family[family_of.get(k, f"only {k}")].append(k)
    families = sorted(by_family.items())
    scale = (1 / (x.std(axis=0) + 1e-4)).astype(np.float32) if len(x) else np.ones(FEATURES, np.float32)
    scale /= np.sqrt(FEATURES)
    machines, weights, bias = [], [], []
    for sides, label in [([f for f, _ in families], np.array([family_of.get(k, f"only {k}") for k in lang])), *((m, lang) for _, m in families)]:
        for p, q in combinations(sides, 2):
            of = np.flatnonzero((label == p) | (label == q))
            w, b = margin_machine(x[of] * scale, np.where(label[of] == p, 1.0, -1.0))
            machines.append((p, q))
            weights.append(w * scale)
            bias.append(b)
    table = np.zeros((FEATURES + 1, len(bias)))
    if bias:
        table[:FEATURES] = np.stack(weights, axis=1)
    return LanguageModel(families, machines, table, np.array(bias))


def identify(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` (text: string) with lang_pred and score (0 to 1).

    A text that is null or has no letter is ``und`` with score 0. Rows are judged one by one, from their text alone.
    Clashing names: the added columns win.
    """
    added = ["lang_pred", "score"]
    keep = [c for c in keep if c not in added]
    held = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES + 1 rows, a column per machine

    def run(batches):
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(c) for c in keep), pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())])
            texts = utf8(batch["text"])
            for lo, hi in passes(texts):
                names, scores = held.value.predict(texts[lo:hi])
                yield rows(schema, **{c: batch[c].slice(lo, hi - lo) for c in keep}, lang_pred=names, score=scores)

    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join([*(f"`{c}` {fields[c]}" for c in keep), "lang_pred string, score double"]))
