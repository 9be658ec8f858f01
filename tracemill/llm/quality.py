"""Quality classification by nearest-neighbour voting over latent-semantic vectors.

Terms are pairs of neighbouring byte classes (letters by themselves, capitals
as one class, digits as one, each punctuation mark, two classes of non-ASCII
bytes), and words that repeat one of the three words before them, counted over
the whole text, damped by a square root, weighted by inverse document frequency
and scaled to unit length. The weight of the repeats and their three distances
(ECHO, LAGS) were chosen by hand, since texts of one word said over and over are
a common kind of junk; they aren't learned. A truncated SVD of the
labelled sample gives the latent space. The labelled vectors are broadcast
with the projection; each block of documents is multiplied with all of them
(exact cosines), and the labels of the nearest neighbours vote with their
similarity as weight.

The labelled sample is bounded by `per_class` documents of each label, drawn
by hash; its feature vectors, not its texts, come to the driver (per_class *
2 * 4,489 floats). All documents are scored.

Given cases: null or empty text has a zero vector and gets the share of label
1 in the sample; a very long text is counted piece by piece; of neighbours that
tie in similarity at the last place those vote that the model has first (by the
hash of their features); without labelled rows every score is 0.5. A label table with
repeated or null rows is read by its distinct non-null pairs; a document with
both labels trains as neither. Repeated rows and equal texts score alike; an
empty table gives an empty one; further columns are carried along untouched,
but for one with the name of the score: it is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.batches import sliced, small_batches
from tracemill.llm.language_id import fold_of

#: 26 letters, capitals, digits, line breaks, blanks, 33 marks, control, lead and trailing bytes of UTF-8.
_OTHER = [b for b in range(33, 127) if not chr(b).isalnum()]
CLASSES = 31 + len(_OTHER) + 4
KIND = np.full(256, 30, np.int32)
for _b in range(256):
    if 97 <= _b <= 122:
        KIND[_b] = _b - 97
    elif 65 <= _b <= 90:
        KIND[_b] = 26
    elif 48 <= _b <= 57:
        KIND[_b] = 27
    elif _b in (10, 13):
        KIND[_b] = 28
    elif _b in (32, 9):
        KIND[_b] = 29
    elif _b in _OTHER:
        KIND[_b] = 31 + _OTHER.index(_b)
    elif _b >= 192:
        KIND[_b] = 31 + len(_OTHER)
    elif _b >= 128:
        KIND[_b] = 32 + len(_OTHER)
PAIRS = CLASSES * CLASSES
LAGS = (1, 2, 3)  # a word equal to the word so many before it is a term by itself
ECHO = 3.0  # its weight before damping would be the square: a text that is all echo has most of its mass there
TERMS = PAIRS + len(LAGS)
PIECE = 1 << 20  # bytes of a text that are counted at a time
BLANK = re.compile(rb"\s")


def word_pieces(data: bytes) -> Iterator[bytes]:
    """data in pieces of some PIECE bytes that end at a blank."""
    lo = 0
    while lo < len(data):
        blank = BLANK.search(data, lo + PIECE) if lo + PIECE < len(data) else None
        hi = blank.start() if blank else len(data)
        yield data[lo:hi]
        lo = hi


def counts(text: str | None) -> np.ndarray:
    """Damped term counts of the whole text."""
    data = (text or "").encode("utf-8", "replace")
    out = np.zeros(TERMS, np.float32)
    for lo in range(0, len(data), PIECE):
        kinds = KIND[np.frombuffer(data[lo : lo + PIECE + 1], np.uint8)]
        out += np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=TERMS)
    last: list[bytes] = []
    for piece in word_pieces(data):
        words = last + piece.split()
        for k, lag in enumerate(LAGS):
            out[PAIRS + k] += ECHO**2 * sum(map(eq, islice(words, max(0, len(last) - lag), None), islice(words, max(len(last), lag), None)))
        last = words[-max(LAGS) :]
    return np.sqrt(out)


class Model:
    """idf, projection, and the labelled latent vectors with their labels."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rank: int, neighbours: int, sharp: float) -> None:
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
        z = self.scaled(x)
        rng = np.random.default_rng(11)
        rank = max(1, min(rank, len(x)))
        q = np.linalg.qr(z.T @ (z @ rng.normal(size=(TERMS, rank + 8)).astype(np.float32)))[0]
        q = np.linalg.qr(z.T @ (z @ q))[0]
        _, _, vt = np.linalg.svd(z @ q, full_matrices=False)
        self.projection = (q @ vt[:rank].T).astype(np.float32)
        self.known = self.unit(z @ self.projection)
        self.y, self.prior = y.astype(np.float32), float(y.mean())
        self.neighbours, self.sharp = min(neighbours, len(x)), sharp

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return self.unit(x * self.idf)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def score(self, x: np.ndarray) -> np.ndarray:
        v = self.unit(self.scaled(x) @ self.projection)
        cos = v @ self.known.T
        near = np.argpartition(-cos, self.neighbours - 1, axis=1)[:, : self.neighbours]
        tied = np.flatnonzero((cos >= np.take_along_axis(cos, near, axis=1).min(axis=1, keepdims=True)).sum(axis=1) > self.neighbours)
        near[tied] = np.argsort(-cos[tied], axis=1, kind="stable")[:, : self.neighbours]  # those that tie at the last place go by their order in the model
        w = np.maximum(np.take_along_axis(cos, near, axis=1), 0) ** self.sharp
        total = w.sum(axis=1)
        vote = np.divide((w * self.y[near]).sum(axis=1), total, out=np.full(len(x), self.prior), where=total > 0)
        return np.clip(np.where((x != 0).any(axis=1), vote, self.prior), 0, 1).astype(np.float64)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        vectors = [counts(t.as_py()).astype(np.float16).tobytes() for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.binary())], names=["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 600, rank: int = 48, neighbours: int = 15, sharp: float = 4.0) -> Model | None:
    """docs(doc_id, text) that may be learned from, labels(doc_id, quality)."""
    small_batches(docs.sparkSession)
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most")).where("label = most").select("doc_id", "label")
    sizes = {r["label"]: r["count"] for r in docs.select("doc_id").join(marks, "doc_id").groupBy("label").count().collect()}
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    share = F.lit(0.0)
    for k, n in sizes.items():
        share = F.when(F.col("label") == k, F.lit(min(1.0, per_class / n))).otherwise(share)
    picked = docs.select("doc_id", "text").join(F.broadcast(marks.where(draw < share).orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * per_class)), "doc_id")
    found = picked.select("label", "text").mapInArrow(_featurise, "label int, x binary").distinct().orderBy(F.xxhash64("x"), "label").limit(4 * per_class).collect()
    if not found:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in found]).astype(np.float32)
    return Model(x, np.array([r["label"] for r in found]), rank, neighbours, sharp)


def scores(docs: DataFrame, model: Model | None, into: str = "score", keep_text: bool = True) -> DataFrame:
    """docs with the score in a new column named `into`; docs must have text."""
    if model is None:
        return docs.withColumn(into, F.lit(0.5)) if keep_text else docs.withColumn(into, F.lit(0.5)).drop("text")
    small_batches(docs.sparkSession)
    docs = docs.drop(into)
    at = docs.columns.index("text")
    held = [i for i in range(len(docs.columns)) if keep_text or i != at]
    schema = T.StructType([*[docs.schema.fields[i] for i in held], T.StructField(into, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in sliced(batches):
            out = np.empty(len(b))
            for lo in range(0, len(b), 256):
                block = b.column(at)[lo : lo + 256]
                out[lo : lo + len(block)] = m.score(np.stack([counts(t.as_py()) for t in block]))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in held], pa.array(out, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def trained(docs: DataFrame, labels: DataFrame, **params) -> Model | None:
    """A model learned from the documents outside fold 1 of 3."""
    return fit(docs.where(fold_of(F.col("doc_id"), 3) != 1), labels, **params)


def classify(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    held = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    out = scores(rows, trained(docs, labels, **params), keep_text=False)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
