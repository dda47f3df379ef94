"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Every word bucket has a sparse random index vector. Over the whole corpus, a bucket's word vector is the sum of the
index vectors of its neighbours. A document's features are the means of its words' vectors and index vectors, and how
far these means concentrate. A network with one hidden layer, trained on a bounded sample of labelled documents, gives
a logit; a temperature fitted on a held-back part of the sample calibrates the probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrid.llm._vec import Rolling, byte_table, flatten, mix, passes, release, rows, utf8

#: Word buckets, dimensions, non-zero entries of an index vector, and neighbours on each side.
BUCKETS, DIMENSIONS, ENTRIES, NEIGHBOURS = 4096, 48, 2, 2
#: The documented bound of the training sample: about so many labelled documents.
SAMPLE = 16_000
#: Score from which a document is predicted to be good.
ACCEPT = 0.7
#: Bytes of text whose words a task holds as vectors at a time.
PASS_BYTES = 500_000
HIDDEN, EPOCHS, SEED = 32, 60, 7

U = np.uint64
_CLASS = np.zeros(256, np.uint8)  # 0 space, 1 lower-case letters, 2 capitals, 3 digits, 4 the rest
_CLASS[byte_table([*range(0x61, 0x7B), *range(0x80, 0x100)])] = 1
_CLASS[byte_table(range(0x41, 0x5B))] = 2
_CLASS[byte_table(range(0x30, 0x3A))] = 3
_CLASS[byte_table(x for x in range(0x80) if not chr(x).isalnum() and x not in (0x20, *range(9, 14)))] = 4


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign of each non-zero entry of each bucket's index vector."""
    seeds = mix(np.arange(BUCKETS * ENTRIES, dtype=U) + U(0x51ED270B)).reshape(BUCKETS, ENTRIES)
    return (seeds % U(DIMENSIONS)).astype(np.int64), np.where(seeds >> U(63), 1.0, -1.0)


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each run of bytes of one class, where each text starts among them, and how many it has."""
    data, start, _ = flatten(texts)
    kind = _CLASS[data]
    cut = np.flatnonzero(np.diff(kind, prepend=kind[:1] ^ 1))
    ends = np.append(cut[1:], len(data))
    some = kind[cut] > 0
    cut, ends = cut[some], ends[some]
    bucket = (Rolling(data).of(cut, ends) % U(BUCKETS)).astype(np.int64)
    first = np.searchsorted(cut, start)
    return bucket, first, np.diff(np.append(first, len(cut)))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vector of each bucket, scaled to length one, from all texts of ``docs``."""

    def run(batches):
        at, sign = index_vectors()
        total = np.zeros(BUCKETS * DIMENSIONS)
        for batch in batches:
            texts = utf8(batch["text"])
            for lo, hi in passes(texts):
                bucket, first, count = buckets(texts[lo:hi])
                text = np.repeat(np.arange(hi - lo), count)
                for k in range(1, NEIGHBOURS + 1):
                    same = np.flatnonzero(text[k:] == text[:-k]) if len(text) > k else np.zeros(0, np.int64)
                    for here, there in ((same, same + k), (same + k, same)):
                        for e in range(ENTRIES):
                            total += np.bincount(bucket[here] * DIMENSIONS + at[bucket[there], e], sign[bucket[there], e], len(total))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])
        release()

    parts = docs.select("text").mapInArrow(run, "sums binary")
    add = lambda a, b: a + b
    total = parts.rdd.map(lambda r: np.frombuffer(r[0])).treeAggregate(np.zeros(BUCKETS * DIMENSIONS), add, add, 3).reshape(BUCKETS, DIMENSIONS)
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """A row for each text."""
    bucket, first, count = buckets(texts)
    at, sign = index_vectors()
    own = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    np.add.at(own, (np.arange(BUCKETS)[:, None], at), sign)
    table = np.concatenate([vectors, own], axis=1)
    out = np.zeros((len(texts), table.shape[1]))
    some = np.flatnonzero(count)
    if len(some):
        out[some] = np.add.reduceat(table[bucket], first[some], axis=0) / count[some, None]
    again = np.append(bucket[1:] == bucket[:-1], False)
    spread = [np.add.reduceat(np.append(x, 0), first)[: len(texts)] * (count > 0) / np.maximum(count, 1) if len(texts) else np.zeros(0) for x in (again.astype(float),)]
    size = np.array([len(t) for t in texts])
    return np.column_stack([out, np.linalg.norm(out[:, :DIMENSIONS], axis=1), np.linalg.norm(out[:, DIMENSIONS:], axis=1), *spread, np.log1p(count), size / np.maximum(count, 1) / 8])


@dataclass
class QualityModel:
    """Scaling of the features, two layers, and the temperature."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = (features(texts, self.vectors) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(_logits(self.layers, x)[0] / self.temperature, -40, 40)))


def _logits(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden @ w2 + b2, hidden


def train(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Two layers by Adam on the cross-entropy, with weight decay."""
    rng = np.random.default_rng(SEED)
    d = x.shape[1]
    layers = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for epoch in range(EPOCHS):
        rate = 3e-3 * (1 - epoch / EPOCHS) + 1e-4
        order = rng.permutation(len(x))
        for i in range(0, len(x), 128):
            of = order[i : i + 128]
            logit, hidden = _logits(layers, x[of])
            wrong = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[of]) / len(of)
            back = np.outer(wrong, layers[2]) * (1 - hidden**2)
            grads = [x[of].T @ back + 1e-4 * layers[0], back.sum(0), hidden.T @ wrong + 1e-4 * layers[2], wrong.sum(keepdims=True)]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                layers[k] = layers[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return layers


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least cross-entropy."""
    grid = np.exp(np.linspace(np.log(0.2), np.log(8), 80))
    loss = [np.logaddexp(0, np.where(y > 0, -1, 1) * logits / t).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit_quality(docs: DataFrame, labels: DataFrame, chosen: Column, sample: int = SAMPLE) -> QualityModel:
    """Learns labels.quality (0 or 1) of about ``sample`` documents that ``chosen`` (over doc_id) admits.

    The word vectors come from the texts of all documents; labels, lang, source and ids enter no feature.
    """
    vectors = word_vectors(docs)
    marked = labels.where(chosen & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = marked.count()
    unit = 1 << 40
    few = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(unit)) < min(unit, unit * sample // max(n, 1)))
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for batch in batches:
            texts = utf8(batch["text"])
            for lo, hi in passes(texts, PASS_BYTES):
                x = features(texts[lo:hi], held.value).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), batch["quality"].slice(lo, hi - lo).cast(pa.int32()), pa.array([r.tobytes() for r in x])], names=["doc_id", "quality", "x"])

    joined = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # about ``sample`` rows of two numbers
    found = sorted(tuple(r) for r in joined.mapInArrow(run, "doc_id long, quality int, x binary").collect())
    width = 2 * DIMENSIONS + 5
    if len({q for _, q, _ in found}) < 2:  # nothing to tell apart
        good = float(np.clip(np.mean([q for _, q, _ in found]) if found else 0.5, 0.01, 0.99))
        layers = [np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([np.log(good / (1 - good))])]
        return QualityModel(vectors, np.zeros(width), np.ones(width), layers, 1.0)
    x, y = np.stack([np.frombuffer(b, np.float32) for *_, b in found]).astype(np.float64), np.array([float(q > 0) for _, q, _ in found])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / scale
    back = np.random.default_rng(SEED).random(len(x)) < 0.2
    temperature = calibrate(_logits(train(x[~back], y[~back]), x[back])[0], y[back]) if back.any() and len(set(y[~back])) == 2 else 1.0
    return QualityModel(vectors, mean, scale, train(x, y), temperature)


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str], accept: float = ACCEPT) -> DataFrame:
    """The columns ``keep`` of ``docs`` (text: string) with score (0 to 1, higher: better) and predicted (score >= accept).

    Null and empty texts get the score of a text without words. Rows are scored one by one, from their text alone.
    Clashing names: the added columns win.
    """
    keep = [c for c in keep if c not in ("score", "predicted")]
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of DIMENSIONS numbers, and the network

    def run(batches):
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(c) for c in keep), pa.field("score", pa.float64()), pa.field("predicted", pa.int32())])
            texts = utf8(batch["text"])
            for lo, hi in passes(texts, PASS_BYTES):
                score = held.value.scores(texts[lo:hi])
                yield rows(schema, **{c: batch[c].slice(lo, hi - lo) for c in keep}, score=score, predicted=(score >= accept).astype(np.int32))
        release()

    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join([*(f"`{c}` {fields[c]}" for c in keep), "score double, predicted int"]))
