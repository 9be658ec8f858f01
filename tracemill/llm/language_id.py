"""Language identification by a byte convolutional network written in numpy.

A text is cut into fixed-length windows of bytes (all of it; the last window is
padded). Filters of several widths slide over the one-hot bytes of a window,
each filter keeps its largest response, and a softmax layer reads these
maxima. A one-hot convolution is a sum of table rows, so a window needs one
gather and one addition per tap and no matrix product. A document's prediction
is the mean of its windows' probabilities, weighted by the bytes they hold.

Training uses a bounded sample of labelled rows (`per_language` documents of
each language, `windows_per_doc` windows of each, drawn by hash); every row is
predicted, over its whole text.

Given cases: null text, and text without a letter, is `und` with score 0; so is
everything if no labelled row exists. Null labels never train. Repeated rows
and equal texts get equal predictions; languages that tie go by the order of
their names. An empty table gives an empty one. A very long text is read in
batches of windows. Null ids are not held out and don't train; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.batches import small_batches

UNKNOWN = "und"
WINDOW = 256
BATCH = 256  # windows at a time
#: ASCII capitals are folded, so that headlines and shouting read like other text.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


@dataclass
class ByteConvNet:
    """tables[w]: (w, 256, filters) tap tables; head: (features, classes)."""

    labels: list[str]
    tables: dict[int, np.ndarray]
    head: np.ndarray
    bias: np.ndarray

    def features(self, windows: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """windows (n, WINDOW) of folded bytes -> maxima (n, features) and the positions they were found at."""
        out, where = [], {}
        for w, table in self.tables.items():
            span = windows.shape[1] - w + 1
            total = table[0].take(windows[:, :span], axis=0)
            for k in range(1, w):
                total += table[k].take(windows[:, k : k + span], axis=0)
            where[w] = total.argmax(axis=1) if self.learning else np.empty(0)
            out.append(total.max(axis=1))
        return np.concatenate(out, axis=1), where

    learning: bool = False

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        x, _ = self.features(windows)
        return softmax(np.maximum(x, 0) @ self.head + self.bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of data, folded and zero-padded, and the bytes each holds."""
    n = max(1, -(-len(data) // WINDOW))
    flat = np.zeros(n * WINDOW, np.uint8)
    flat[: len(data)] = FOLD[np.frombuffer(data, np.uint8)]
    held = np.full(n, WINDOW, np.float32)
    held[-1] = max(1, len(data) - (n - 1) * WINDOW)
    return flat.reshape(n, WINDOW), held


def train(windows: np.ndarray, labels: list[str], widths: tuple[int, ...] = (2, 3, 4), filters: int = 12, epochs: int = 6, rate: float = 0.01, seed: int = 7) -> ByteConvNet:
    """Adam on the cross-entropy; only the byte rows at each maximum get a gradient."""
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    net = ByteConvNet(names, {w: rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths}, rng.normal(0, 0.1, (filters * len(widths), len(names))).astype(np.float32), np.zeros(len(names), np.float32), learning=True)
    params = [*net.tables.values(), net.head, net.bias]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = np.array([len(y) / (len(names) * max(1, (y == c).sum())) for c in range(len(names))], np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 64):
            pick = order[lo : lo + 64]
            x, where = net.features(windows[pick])
            act = np.maximum(x, 0)
            g = softmax(act @ net.head + net.bias)
            g[np.arange(len(pick)), y[pick]] -= 1
            g *= weight[y[pick], None] / len(pick)
            gx = (g @ net.head.T) * (x > 0)
            grads, rows = [], np.arange(len(pick))[:, None]
            for i, w in enumerate(widths):
                gt = np.zeros_like(net.tables[w])
                part = gx[:, i * filters : (i + 1) * filters]
                for k in range(w):
                    np.add.at(gt[k], (windows[pick][rows, where[w] + k], np.arange(filters)[None, :]), part)
                grads.append(gt)
            grads += [act.T @ g, g.sum(axis=0)]
            t += 1
            for p, d, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    net.learning = False
    return net


def sample_windows(rows: DataFrame, per_language: int, windows_per_doc: int) -> tuple[np.ndarray, list[str]]:
    """rows(text, lang), labelled -> windows for training. A count per language (no text read) sets the share that is drawn by hash; the draw is cut to its bound in a fixed order."""
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), []
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / float(1 << 40)
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, per_language / n))).otherwise(share)
    at = lambda k: F.pmod(F.xxhash64(F.col("text"), F.lit(k)), F.greatest(F.lit(1), F.char_length("text") - WINDOW)).cast("int") + 1
    cuts = F.array(*[F.substring(F.col("text"), at(k), F.lit(WINDOW)) for k in range(windows_per_doc)])
    drawn = rows.where(draw < share).select("lang", F.xxhash64("text").alias("h"), cuts.alias("cuts")).distinct().orderBy("h", "lang", "cuts").limit(2 * per_language * len(counts))
    windows, labels = [], []
    for r in drawn.collect():
        for c in set(r["cuts"]):
            w, _ = cut(c.encode("utf-8", "replace")[:WINDOW])
            windows.append(w[0])
            labels.append(r["lang"])
    return np.array(windows, np.uint8).reshape(-1, WINDOW), labels


def predict(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """docs(doc_id, held_out, text) -> doc_id, held_out, lang_pred, score."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    src = docs.select("doc_id", "held_out", F.when(lettered, F.col("text")).alias("text"))
    if net is None:
        return src.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2)
            sums = np.zeros((len(texts), len(net.labels)))
            pend: list[np.ndarray] = []
            owner: list[np.ndarray] = []
            held: list[np.ndarray] = []

            def flush() -> None:
                if not pend:
                    return
                w, o, h = np.concatenate(pend), np.concatenate(owner), np.concatenate(held)
                for lo in range(0, len(w), BATCH):
                    s = slice(lo, lo + BATCH)
                    np.add.at(sums, o[s], net.probabilities(w[s]) * h[s, None])
                pend.clear(), owner.clear(), held.clear()

            waiting = 0
            for i, t in enumerate(texts):
                if not t.is_valid:
                    continue
                w, h = cut(t.as_py().encode("utf-8", "replace"))
                pend.append(w)
                held.append(h)
                owner.append(np.full(len(w), i))
                waiting += len(w)
                if waiting >= 8 * BATCH:
                    flush()
                    waiting = 0
            flush()
            total = sums.sum(axis=1)
            best = sums.argmax(axis=1)
            score = np.divide(sums.max(axis=1), total, out=np.zeros(len(total)), where=total > 0)
            names = [net.labels[k] if s > 0 else UNKNOWN for k, s in zip(best, total, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return src.mapInArrow(run, schema)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def identify(docs: DataFrame, per_language: int = 400, windows_per_doc: int = 4) -> DataFrame:
    """Learn from the rows outside fold 0 of 5 that have a lang, then predict all rows. A null id is not held out, and doesn't train."""
    fold = fold_of(F.col("doc_id"), 5)
    rows = docs.where((fold != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    windows, labels = sample_windows(rows, per_language, windows_per_doc)
    net = train(windows, labels) if labels else None
    return predict(docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text"), net)
