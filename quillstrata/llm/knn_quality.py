"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's features are hashed byte trigrams, weighted tf-idf, and a few shares of its style (symbols, capitals, repeated
words and the like).  A truncated singular value decomposition of the labelled sample gives the latent space.  The labelled vectors
and the projection are broadcast (a few MB: their size is bounded by SAMPLE); every text is projected, multiplied
with all labelled vectors block by block, and its NEAREST neighbours vote with weights that grow with their cosine.

SAMPLE rows of each label, those of lowest hash, are fitted on; votes are weighted back to the labels' shares among all labelled rows.
Defined results: null and empty texts get the labels' prior as score; without labelled rows every score is 0.5; two
labels for one document both count; rows are answered one by one, so repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import sample

HASHED, LATENT, NEAREST, SAMPLE, BLOCK = 2048, 48, 25, 2048, 256
STYLE, STYLE_WEIGHT = 8, 3.0
#: Cosines are raised to this power for a vote's weight.
SHARPNESS = 8
GOOD_FROM = 0.7
_SYMBOLS, _UPPER, _DIGIT = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"))
_BANG = np.arange(256) == 33


def features(text: str) -> np.ndarray:
    """HASHED trigram counts, damped, then STYLE shares."""
    data = text.encode()
    out = np.zeros(HASHED + STYLE, np.float32)
    b = np.frombuffer(data, np.uint8)
    if len(b) >= 3:
        c = b.astype(np.uint32)
        h = (c[:-2] * 2654435761 + c[1:-1] * 40503 + c[2:] * 2246822519) & 0xFFFFFFFF
        counts = np.bincount(((h ^ (h >> 15)) * 2654435761 & 0xFFFFFFFF) >> 21, minlength=HASHED)
        out[:HASHED] = np.log1p(counts)
    words = data.split()
    if words:
        n, size = len(words), len(b)
        bytes_of = np.bincount(b, minlength=256)
        repeated = sum(map(bytes.__eq__, words, words[1:]))
        out[HASHED:] = (
            min(1.0, bytes_of[_SYMBOLS].sum() / n), min(1.0, 2 * bytes_of[_UPPER].sum() / size), min(1.0, bytes_of[_BANG].sum() / n), min(1.0, 4 * bytes_of[_DIGIT].sum() / size),
            min(1.0, 2 * repeated / n), 1.0 if n < 50 else 0.0, min(1.0, n / len(set(words)) / 20), min(1.0, size / n / 30),
        )
    return out


@dataclass
class Neighbours:
    """idf (HASHED), basis (HASHED + STYLE, LATENT), vectors (rows, LATENT) of length 1, labels (rows), weights (rows), prior."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, prior: float) -> Neighbours:
        idf = np.log((1 + len(x)) / (1 + (x[:, :HASHED] > 0).sum(0))).astype(np.float32) + 1
        scaled = cls._scaled(x, idf)
        _, vectors = np.linalg.eigh(scaled.T @ scaled)
        basis = np.ascontiguousarray(vectors[:, ::-1][:, :LATENT])
        share = np.array([np.mean(y == 0), np.mean(y == 1)])
        real = np.array([1 - prior, prior])
        return cls(idf, basis, cls._unit(scaled @ basis), y.astype(np.float32), (real / np.maximum(share, 1e-9))[y].astype(np.float32), prior)

    @staticmethod
    def _scaled(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
        hashed, style = x[:, :HASHED] * idf, x[:, HASHED:] * STYLE_WEIGHT
        return np.concatenate([hashed / np.maximum(np.linalg.norm(hashed, axis=1, keepdims=True), 1e-9), style], axis=1)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The neighbours' weighted share of label 1, with the prior as one more vote."""
        cos = self._unit(self._scaled(x, self.idf) @ self.basis) @ self.vectors.T
        k = min(NEAREST, cos.shape[1])
        near = np.argpartition(cos, cos.shape[1] - k, axis=1)[:, -k:]
        w = np.maximum(np.take_along_axis(cos, near, 1), 0) ** SHARPNESS * self.weights[near]
        return np.where(x.any(axis=1), ((w * self.labels[near]).sum(1) + 0.1 * self.prior) / (w.sum(1) + 0.1), self.prior)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def _featurized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t or "").tobytes() for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("quality"), pa.array(x, pa.binary())], ["quality", "x"])


def train(docs: DataFrame, labels: DataFrame) -> Neighbours | None:
    """Fits on labelled rows that aren't held out, SAMPLE of each label at most."""
    labelled = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & ~held_out()).distinct()
    counts = {r["quality"]: r["count"] for r in labelled.groupBy("quality").count().collect()}
    if not counts:
        return None
    drawn = [sample(labelled.filter(F.col("quality") == q), SAMPLE, "doc_id") for q in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn[0].union(drawn[1])), "doc_id").select("quality", "text")
    found = sorted((r["quality"], bytes(r["x"])) for r in rows.mapInArrow(_featurized, "quality int, x binary").collect())
    if not found:
        return None
    x = np.stack([np.frombuffer(v, np.float32) for _, v in found])
    return Neighbours.fit(x, np.array([q for q, _ in found]), counts.get(1, 0) / sum(counts.values()))


def classify(docs: DataFrame, model: Neighbours | None) -> DataFrame:
    """doc_id, score, predicted for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts) if known else 0, BLOCK):
                scores[at : at + BLOCK] = known.score(np.stack([features(t or "") for t in texts[at : at + BLOCK]]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= GOOD_FROM).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of query op5."""
    out = classify(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
