"""Document quality by attention-based multiple-instance learning over passages.

A document is a bag of passages. Every passage is encoded, gated attention weighs the encodings, and the weighted sum is
scored; all of it is learned from labels of whole documents, so no passage needs a label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import remainder, returning_memory, text_of
from corpusflow.llm.shingles import BYTES_AT_ONCE, word_hashes

PASSAGE = 512  # bytes
CODES = np.minimum(np.arange(256), 128)  # ASCII bytes each, all others together
N_CODES, N_WORD = 129, 7
FEATURES = N_CODES + N_WORD
HIDDEN, GATES = 32, 16
SAMPLE_DOCUMENTS, SAMPLE_PASSAGES = 4000, 80_000  # bounds of what the model is fitted on


def _word_features(data: np.ndarray, offsets: np.ndarray, words_at: np.ndarray, hashes: np.ndarray, first: np.ndarray, passage_of_word: np.ndarray, n: int) -> np.ndarray:
    """Per passage: words by length, how often a word equals one of the four before it, and how often it is one character."""
    out = np.zeros((n, N_WORD), np.float32)
    if not len(hashes):
        return out
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    count = np.maximum(np.bincount(passage_of_word, minlength=n), 1)
    for lag in range(1, 5):
        same = np.zeros(len(hashes), bool)
        same[lag:] = (hashes[lag:] == hashes[:-lag]) & (doc[lag:] == doc[:-lag])
        out[:, lag - 1] = np.bincount(passage_of_word, same, minlength=n) / count
    length = np.diff(np.append(words_at, len(data)))
    out[:, 4] = np.log1p(np.bincount(passage_of_word, length, minlength=n) / count)
    out[:, 5] = np.bincount(passage_of_word, length <= 2, minlength=n) / count
    keys = np.unique(passage_of_word.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    out[:, 6] = np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=n) / count
    return out


def passages(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features of the passages, first passage of each text) for slices of an Arrow array of strings without nulls.

    Passages are the texts' runs of PASSAGE bytes; an empty text has one passage without bytes.
    """
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + BYTES_AT_ONCE, side="right")) - 1)
        data, offsets = whole[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
        sizes = np.diff(offsets)
        each = np.maximum(1, -(-sizes // PASSAGE))
        first = np.concatenate([[0], np.cumsum(each)])
        n = int(first[-1])
        passage = np.repeat(first[:-1], sizes) + (np.arange(len(data)) - np.repeat(offsets[:-1], sizes)) // PASSAGE
        counts = np.bincount(passage * N_CODES + CODES[data], minlength=n * N_CODES).reshape(n, N_CODES)
        share = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)
        with np.errstate(over="ignore"):
            hashes, word_first = word_hashes(data, offsets)
        solid = ~np.isin(data, (9, 10, 11, 12, 13, 32))
        starts = solid.copy()
        starts[1:] &= ~solid[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        starts[edges] = solid[edges]
        at = np.flatnonzero(starts)
        yield np.hstack([share, _word_features(data, offsets, at, hashes, word_first, passage[at], n)]), first
        low = high


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Attention:
    """Encoder, gated attention and scorer; parameters are numpy arrays."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.p = {
            "W": rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATES)),
            "U": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATES)), "w": rng.normal(0, 1 / np.sqrt(GATES), GATES), "c": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        p, starts = self.p, first[:-1]
        bag = np.repeat(np.arange(len(starts)), np.diff(first))
        h = np.tanh((x - self.mean) / self.spread @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return h, t, g, a, z, bag, _sigmoid(z @ p["c"] + p["d"])

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.p, first[:-1]
        h, t, g, a, z, bag, score = self.forward(x, first)
        do = (score - y) / len(y)
        dz = (do[:, None] * p["c"])[bag]
        da = (h * dz).sum(1)
        de = a * (da - np.add.reduceat(a * da, starts)[bag])
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": ((x - self.mean) / self.spread).T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ do, "d": do.sum(keepdims=True)}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)[-1]


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.005, decay: float = 1e-4, seed: int = 7) -> Attention:
    """Adam on the logistic loss of the documents' labels."""
    every = np.concatenate(bags) if bags else np.zeros((1, FEATURES))
    model = Attention(every.mean(0), every.std(0) + 0.05, seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    rng, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for low in range(0, len(order), batch):
            chosen = order[low : low + batch]
            x = np.concatenate([bags[i] for i in chosen])
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in chosen])])
            step += 1
            for k, grad in model.gradients(x, first, labels[chosen]).items():
                grad = grad + decay * model.p[k]
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                model.p[k] = model.p[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", modulus: int = 5, documents: int = SAMPLE_DOCUMENTS, most: int = SAMPLE_PASSAGES) -> Attention:
    """The model fitted on at most `documents` labelled rows (and `most` passages) whose key's remainder is not 0.

    The rows with the smallest hashes of their keys are taken: a bounded, repeatable sample. It meets the documents by a
    broadcast of those keys; only the passages' features of the sample come to the driver. A document whose passages would
    pass `most` is left out and the next ones are still taken; one that has more than `most` alone stays in its task.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & (remainder(key, modulus) != 0))
    chosen = chosen.groupBy(F.col(key).alias("key")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("key"), "key").limit(documents)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x[a:b].astype("<f4").tobytes() if b - a <= most else None for x, first in passages(batch.column(2)) for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["key", "label", "bag"])

    sample = docs.select(F.col(key).alias("key"), text_of(text).alias("body")).join(F.broadcast(chosen), "key")
    made = sample.select("key", "label", "body").mapInArrow(returning_memory(encode), f"key {dict(docs.dtypes)[key]}, label int, bag binary")
    bags, marks, total = [], [], 0
    for row in made.filter(F.col("bag").isNotNull()).orderBy(F.xxhash64("key"), "key", "bag").limit(documents).toLocalIterator():
        bag = np.frombuffer(row["bag"], "<f4").reshape(-1, FEATURES)
        if total + len(bag) > most:
            continue
        total += len(bag)
        bags.append(bag), marks.append(row["label"])
    return fit(bags, np.array(marks, float))


def score(docs: DataFrame, model: Attention, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row: all passages of the whole text. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(x, first) for x, first in passages(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "score"])

    return docs.select(F.col(key).alias("doc_id"), text_of(text).alias("body")).mapInArrow(returning_memory(run), f"doc_id {dict(docs.dtypes)[key]}, score double")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Labels, language, source and key are no inputs of a score. Empty and null texts have one empty passage and get a score
    like any other. Without labelled rows every score is that of an untrained model. Repeated rows keep their rows. Labels
    that contradict each other are averaged; null ones are left out.
    """
    scored = score(docs, train(docs, labels, key, text, **options), key, text)
    return scored.select("doc_id", (remainder("doc_id", options.get("modulus", 5)) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """The rows whose text scores at least the threshold, with all their columns."""
    model = train(docs, labels, text=text, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(batch.schema.get_field_index(text))
            bodies = bodies.fill_null("") if bodies.null_count else bodies
            scores = [model.score(x, first) for x, first in passages(bodies)]
            yield batch.filter(pa.array(np.concatenate(scores) >= threshold if scores else np.zeros(0, bool)))

    return docs.mapInArrow(returning_memory(run), docs.schema)
