"""Quality classifier: a convolutional network over bytes, in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Bytes are embedded, learned filters of
`2 * GROUP` bytes move over the chunk in steps of GROUP, each filter's largest answer in the chunk goes on
(max pooling) through a small dense layer to the chunk's logit, and the mean of a text's chunk logits is the
logit of its probability. Embedding, filters and dense layers are learned together, by Adam, from chunks of
at most about `SAMPLE` labelled rows on the driver; documents are scored in tasks.

Cases: a null or empty text is one empty chunk. Chunks are filled up with zero bytes. Without labels, or
with labels of one kind only, the score is their smoothed share. Repeated rows score alike to single precision. A long text
is scored in pieces of bounded size. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octroi.llm.common import ranges, small_batches, steps
from octroi.llm.labels import held_out, training_sample

#: Labelled rows learned from, and chunks of each.
SAMPLE, SAMPLE_CHUNKS = 6_000, 5
CHUNK, STRIDE, GROUP = 512, 448, 4
EMBED, FILTERS, HIDDEN = 8, 32, 16
EPOCHS, BATCH_DOCS = 12, 64
THRESHOLD = 0.5


def chunk_starts(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and start (within the row) of chunks; together they cover every byte, neighbours share CHUNK - STRIDE."""
    n = np.maximum(1, -(-(lengths - (CHUNK - STRIDE)) // STRIDE))
    return np.repeat(np.arange(len(lengths)), n), ranges(n) * STRIDE


def chunk_bytes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Matrix of chunks that start at `begin`; zeros from `end` on."""
    at = begin[:, None] + np.arange(CHUNK)
    if not len(data):
        return np.zeros(at.shape, np.uint8)
    return np.where(at < end[:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "embed": draw(256, EMBED, scale=0.5), "filters": draw(2 * GROUP * EMBED, FILTERS, scale=0.18), "bias": np.zeros(FILTERS, np.float32),
            "dense": draw(FILTERS, HIDDEN, scale=0.25), "dense_bias": np.zeros(HIDDEN, np.float32), "out": draw(HIDDEN, scale=0.3), "out_bias": np.zeros(1, np.float32),
        }

    def pooled(self, chunks: np.ndarray, places: bool = False):
        """Largest answer of each filter in each chunk (and where)."""
        groups = self.p["embed"][chunks].reshape(-1, GROUP * EMBED)
        half = GROUP * EMBED
        both = groups @ np.concatenate([self.p["filters"][:half], self.p["filters"][half:]], axis=1)
        both = both.reshape(len(chunks), CHUNK // GROUP, 2 * FILTERS)
        answer = both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:]
        if not places:
            return np.maximum(answer.max(1) + self.p["bias"], 0)
        where = answer.argmax(1)
        return np.maximum(np.take_along_axis(answer, where[:, None], 1)[:, 0] + self.p["bias"], 0), where

    def logits(self, chunks: np.ndarray) -> np.ndarray:
        h = np.maximum(self.pooled(chunks) @ self.p["dense"] + self.p["dense_bias"], 0)
        return h @ self.p["out"] + self.p["out_bias"]

    def gradients(self, chunks: np.ndarray, doc: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of documents; `doc` says whose the chunks are."""
        p = self.p
        v, where = self.pooled(chunks, places=True)
        z = v @ p["dense"] + p["dense_bias"]
        h = np.maximum(z, 0)
        share = 1 / np.bincount(doc, minlength=len(y))
        logit = np.bincount(doc, h @ p["out"] + p["out_bias"], len(y)) * share
        error = (1 / (1 + np.exp(-logit)) - y) / len(y)
        d = (error * share)[doc].astype(np.float32)
        dz = d[:, None] * p["out"] * (z > 0)
        dv = (dz @ p["dense"].T) * (v > 0)
        b, f = np.nonzero(dv)
        at = where[b, f][:, None] * GROUP + np.arange(2 * GROUP)
        letters = chunks[b[:, None], at]
        window = p["embed"][letters].reshape(len(b), -1)
        g = dv[b, f]
        filters = np.zeros((FILTERS, window.shape[1]), np.float32)
        np.add.at(filters, f, window * g[:, None])
        embed = np.zeros_like(p["embed"])
        np.add.at(embed, letters.ravel(), (p["filters"].T[f] * g[:, None]).reshape(-1, EMBED))
        return {"embed": embed, "filters": filters.T, "bias": dv.sum(0), "dense": v.T @ dz, "dense_bias": dz.sum(0), "out": h.T @ d, "out_bias": np.array([d.sum()])}

    def train(self, chunks: np.ndarray, doc: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 4e-3) -> None:
        """chunks are sorted by doc; y has a label for each doc."""
        first = np.searchsorted(doc, np.arange(len(y) + 1))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        r, t, total = np.random.default_rng(3), 0, epochs * -(-len(y) // BATCH_DOCS)
        for _ in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), BATCH_DOCS):
                ids = order[i : i + BATCH_DOCS]
                n = first[ids + 1] - first[ids]
                g = self.gradients(chunks[np.repeat(first[ids], n) + ranges(n)], np.repeat(np.arange(len(ids)), n), y[ids])
                t += 1
                step = rate * (1 - t / total) + 1e-5
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.999 * s[k] + 0.001 * v * v
                    self.p[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)


def training_chunks(sample: DataFrame) -> DataFrame:
    """label, chunks: up to SAMPLE_CHUNKS chunks of each text, spread evenly over the whole of it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in steps(batches):
            n = np.diff(at)
            row, start = chunk_starts(n)
            all_of = np.bincount(row, minlength=len(n))
            k = ranges(all_of)
            few = np.minimum(all_of, SAMPLE_CHUNKS)[row]
            keep = (k * few) // all_of[row] != ((k - 1) * few) // all_of[row]
            row, start = row[keep], start[keep]
            made = chunk_bytes(data, at[row] + start, at[row + 1])
            bounds = np.searchsorted(row, np.arange(len(n) + 1))
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int32()), pa.array([made[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["label", "chunks"])

    return sample.select("label", "text").mapInArrow(cut, "label int, chunks binary")


def learn(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE) -> Network | float:
    """A trained network, or the logit of the labels' share if they are of one kind."""
    rows = training_chunks(training_sample(docs, labels, column, sample)).collect()  # bounded by the sample
    rows.sort(key=lambda r: (r.label, bytes(r.chunks)))
    y = np.array([r.label > 0 for r in rows], float)
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 0.5) / (len(y) + 1)
        return float(np.log(share / (1 - share)))
    made = [np.frombuffer(r.chunks, np.uint8).reshape(-1, CHUNK) for r in rows]
    net = Network()
    net.train(np.concatenate(made), np.repeat(np.arange(len(made)), [len(m) for m in made]), y, max(EPOCHS, min(60, 40_000 // len(y))))
    return net


def score_texts(net: Network | float, data: np.ndarray, at: np.ndarray, piece: int = 512) -> np.ndarray:
    """Probability of each row; all chunks of all rows, `piece` chunks at once."""
    n = len(at) - 1
    if isinstance(net, float):
        return np.full(n, 1 / (1 + np.exp(-net)))
    row, start = chunk_starts(np.diff(at))
    begin, end = at[row] + start, at[row + 1]
    logit = np.concatenate([net.logits(chunk_bytes(data, begin[i : i + piece], end[i : i + piece])) for i in range(0, len(row), piece)])
    return 1 / (1 + np.exp(-np.bincount(row, logit, n) / np.bincount(row, minlength=n)))


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of `docs` (doc_id, text)."""
    small_batches(docs.sparkSession)
    net = learn(docs, labels, sample=sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in steps(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score_texts(net, data, at).astype(float))], names=["doc_id", "score"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(score, "doc_id long, score double").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that `quality` accepts, with all their columns; they are judged where they are read."""
    small_batches(docs.sparkSession)
    net = learn(docs, labels, sample=sample)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in steps(batches):
            yield rows.filter(pa.array(score_texts(net, data, at) >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
