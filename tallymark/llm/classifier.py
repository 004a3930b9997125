"""Quality of texts by a small convolutional network over bytes, in numpy.

A text's bytes are cut into chunks that overlap and cover all of it. Learned
filters slide over each chunk; each filter's largest answer is the chunk's
value for it. The mean and the largest of the chunks' values, weighted and
added up, give one probability.

The network is fitted on a bounded sample of labelled rows: the first
``SAMPLE_ROWS`` in the order of a hash of their id. Scoring runs over all rows
in tasks, without a shuffle; only the text is an input.

Defined results: a missing or empty text is one chunk of padding and gets a
score as any other. Rows whose label or id is missing are not learned from; of
several labels of a document the lowest counts. Without any labelled row every
score is 0.5. Repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import one_by_one

CHUNK, STEP = 512, 448  # bytes in a chunk, and from one chunk to the next
WIDTH, FILTERS, DEPTH = 6, 16, 8  # bytes under a filter, filters, numbers for a byte
PAD = 256  # stands for what lies behind the end of a text
SAMPLE_ROWS = 4000
EPOCHS, RATE, GROUP_DOCS = 5, 0.01, 32
_AT_ONCE = 64  # chunks in one multiplication


@dataclass
class Network:
    bytes_: np.ndarray  # (257, DEPTH)
    filters: np.ndarray  # (WIDTH * DEPTH, FILTERS)
    shift: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,)
    bias: np.ndarray  # (1,)

    def parameters(self):
        return [self.bytes_, self.filters, self.shift, self.weights, self.bias]


def chunks_of(text: bytes) -> np.ndarray:
    """(chunks, CHUNK) of byte numbers; the last chunk is padded."""
    n = 1 + max(0, -(-(len(text) - CHUNK) // STEP))
    padded = np.full((n - 1) * STEP + CHUNK, PAD, np.uint16)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


def pooled(net: Network, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest answer of each filter in each chunk, and where it was."""
    values = np.empty((len(chunks), FILTERS), np.float32)
    places = np.empty((len(chunks), FILTERS), np.int64)
    for at in range(0, len(chunks), _AT_ONCE):
        seen = net.bytes_[chunks[at : at + _AT_ONCE]]
        n = len(seen)
        under = np.lib.stride_tricks.sliding_window_view(seen.reshape(n, -1), WIDTH * DEPTH, axis=1)[:, ::DEPTH]
        answers = (under.reshape(-1, WIDTH * DEPTH) @ net.filters).reshape(n, -1, FILTERS)
        best = answers.argmax(axis=1)
        places[at : at + n] = best
        values[at : at + n] = np.take_along_axis(answers, best[:, None], axis=1)[:, 0]
    return np.maximum(values + net.shift, 0), places


def combined(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: mean and largest of its chunks' values; ``first``: where its chunks begin."""
    sizes = np.diff(np.append(first, len(values)))[:, None]
    return np.add.reduceat(values, first, axis=0) / sizes, np.maximum.reduceat(values, first, axis=0)


def probability(net: Network, mean: np.ndarray, top: np.ndarray) -> np.ndarray:
    sums = (np.hstack([mean, top]) @ net.weights + net.bias).astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


def score(net: Network, texts) -> np.ndarray:
    """The score of each text of a list or Arrow array."""
    out = np.empty(len(texts))
    start, held, parts = 0, 0, []
    for i, text in enumerate(one_by_one(texts)):
        parts.append(chunks_of((text or "").encode()))
        held += len(parts[-1])
        if held >= 8 * _AT_ONCE or i == len(texts) - 1:
            first = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
            out[start : i + 1] = probability(net, *combined(pooled(net, np.concatenate(parts))[0], first))
            start, held, parts = i + 1, 0, []
    return out


def fit(texts: list[bytes], labels: list[int], seed: int = 7) -> Network:
    """Gradient steps (Adam) on the logarithmic loss; the same rows give the same network."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (257, DEPTH)).astype(np.float32),
        rng.normal(0, 0.3, (WIDTH * DEPTH, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), np.zeros(1, np.float32),
    )
    wanted = np.array(labels, np.float64)
    if not len(wanted):
        net.weights[:] = 0
        return net
    rate = np.clip(wanted.mean(), 0.01, 0.99)
    net.bias[0] = np.log(rate / (1 - rate))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), GROUP_DOCS):
            group = order[at : at + GROUP_DOCS]
            step += 1
            gradients = _gradients(net, [texts[i] for i in group], wanted[group])
            for p, g, (m, v) in zip(net.parameters(), gradients, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return net


def _gradients(net: Network, texts: list[bytes], wanted: np.ndarray) -> list[np.ndarray]:
    parts = [chunks_of(t) for t in texts]
    sizes = np.array([len(p) for p in parts])
    first = np.cumsum(sizes) - sizes
    chunks = np.concatenate(parts)
    values, places = pooled(net, chunks)
    mean, top = combined(values, first)
    error = ((probability(net, mean, top) - wanted) / len(texts)).astype(np.float32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    is_top = values == top[owner]
    back = error[owner, None] * (net.weights[:FILTERS] / sizes[owner, None] + net.weights[FILTERS:] * is_top)
    back = np.where(values > 0, back, 0).astype(np.float32)
    # only the bytes under each filter's best place count
    under = chunks[np.arange(len(chunks))[:, None, None], places[:, :, None] + np.arange(WIDTH)]
    seen = net.bytes_[under].reshape(len(chunks), FILTERS, -1)
    filters = np.einsum("cfk,cf->kf", seen, back)
    to_bytes = back[:, :, None] * net.filters.T[None]
    bytes_ = np.zeros_like(net.bytes_)
    np.add.at(bytes_, under.ravel(), to_bytes.reshape(-1, DEPTH))
    weights = np.concatenate([error @ mean, error @ top])
    return [bytes_, filters, back.sum(axis=0), weights, error.sum(keepdims=True)]


def held_out(doc_id: str):
    """Every third document, by a checksum of its id; these are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> tuple[list, list]:
    """At most ``rows`` labelled texts, not held out, chosen by a hash of their id."""
    chosen = (
        labels.where(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("__label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    ids = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("__text"))
    # ``chosen`` has at most ``rows`` rows of two numbers
    found = ids.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "__text").limit(rows).collect()
    return [r["__text"].encode() for r in found], [r["__label"] for r in found]


def scored(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``score``."""
    rest = [f for f in docs.schema.fields if f.name not in (text, "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", score double"

    def run(batches):
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in rest]
            texts = batch.column(batch.schema.get_field_index(text))
            yield pa.record_batch([*columns, pa.array(score(net, texts))], names=[*(f.name for f in rest), "score"])

    return docs.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (the chance of label 1), predicted."""
    net = fit(*training_rows(docs, labels, label))
    pairs = docs.select("doc_id", "text")
    return scored(pairs, net).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
