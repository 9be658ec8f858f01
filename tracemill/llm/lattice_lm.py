"""Language-model scores: the marginal probability of a text over all segmentations into the pieces of a given vocabulary.

A text is its words (capitals A-Z folded), each with a blank before it, and an
end. Pieces are spelt one after another and independently, so a text's
probability is the sum over all ways to cut it into pieces. No piece spans the
blank between two words, so all paths of the lattice meet there: a text's log
probability is the sum of its words' marginals, each found by a forward
recursion in log space, and that of the end.

The vocabulary is given, with its scores; it is never trained. The scores of a
byte-pair model are ranks (0, -1, -2, ...), which Zipf's law makes shares:
1 / (rank + ZIPF). Every byte is a piece by itself, last in rank, so that every
text has a segmentation. These shares weigh all segmentations of the training
words once (forward and backward), which gives every piece its expected count;
the given shares add `prior` expected counts to these. A word of the training
rows is one more arc across its own lattice, with its share of the tokens less
`discount` occurrences, and the discounted mass goes to its spelling in pieces.
`vocabulary_score` is the marginal under the given shares alone, in which
nothing is learned.

1. Words are counted per partition with bounded tables, and added up by word:
   one row for each distinct word of the corpus.
2. Expected counts and marginals are computed once for each distinct word, in
   arrays over many words at a time; only counts by piece reach the driver.
3. Documents are scanned again. The most frequent words are broadcast, as many
   as a fixed number of words and bytes admits; occurrences of the others are
   joined by word. So a word that fills the corpus isn't shuffled and rare ones
   aren't broadcast, and both get the same score as in one table.

Given cases: null, empty and blank texts are the end alone; a null id trains
nothing and isn't held out; repeated rows count and score each; equal texts get
equal scores but for the order of addition; without training rows base_score is
0 and the given shares are the model; a text of any length is worked on whole,
and so is a word; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.batches import relax, sliced, small_batches, word_pieces
from tracemill.llm.language_id import fold_of
from tracemill.session import Scratch, stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ZIPF = 2.7  # Mandelbrot's shift of the ranks
PRIOR = 10_000.0  # expected counts that the given shares stand for beside those of the corpus
DISCOUNT = 0.5  # occurrences of a training word that go to words by their spelling
TABLE = 1 << 18  # distinct words that a task counts before it hands them on
RARE = 1 << 14  # occurrences of words outside the broadcast table in a row
FREQUENT, FREQUENT_BYTES = 1 << 18, 4 << 20  # words that are broadcast at most, and their bytes
BATCH = 1 << 19  # bytes of distinct words that are worked on at a time
#: Blank, and the bytes 9 to 13, end a word; capitals are folded.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
END = b""  # no word is empty
LOG10 = float(np.log(10))


class Pieces:
    """The pieces of a model as byte strings, in a trie whose edges are found by hash, with the shares that its scores give."""

    def __init__(self, model: str, zipf: float = ZIPF) -> None:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        spelt: dict[bytes, float] = {}
        for i in range(p.get_piece_size()):
            if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)) and p.get_score(i) > -1e8:
                spelt[p.id_to_piece(i).replace("▁", " ").encode()] = p.get_score(i)
        self._build(spelt, zipf)

    @classmethod
    def of(cls, spelt: dict[bytes, float], zipf: float = ZIPF) -> Pieces:
        """From piece -> score, for vocabularies that aren't in a file."""
        self = cls.__new__(cls)
        self._build(spelt, zipf)
        return self

    def _build(self, spelt: dict[bytes, float], zipf: float) -> None:
        self.spelt = list(spelt)
        n = len(spelt)
        top = max(spelt.values(), default=0.0)
        rank = np.array([top - s for s in spelt.values()] + [float(max(n, top - min(spelt.values(), default=0.0)))] * 256 + [0.0])
        weight = 1 / (rank + zipf)  # pieces, single bytes, the end
        self.log_share = np.log(weight / weight.sum())
        self.end = n + 256
        edges, ends, nodes = {}, {}, 1
        for i, x in enumerate(self.spelt):
            at = 0
            for b in x:
                at, nodes = (edges[at, b], nodes) if (at, b) in edges else (edges.setdefault((at, b), nodes), nodes + 1)
            ends[at] = i
        self.longest = max(map(len, self.spelt), default=1)
        self.piece = np.full(nodes, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.bits = max(4, (4 * len(edges)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        keys, to = np.array([a << 8 | b for a, b in edges], np.int64), np.array(list(edges.values()), np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            first = np.zeros(len(keys), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.to[slot[put]] = keys[put], to[put]
            keys, to, slot = keys[~put], to[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of every node by its byte; 0 where there is none."""
        keys = node.astype(np.int64) << 8 | byte
        slot, out = self._slot(keys), np.zeros(len(keys), np.int32)
        left = np.arange(len(keys))
        while len(left):
            found = self.keys[slot[left]]
            same = found == keys[left]
            out[left[same]] = self.to[slot[left[same]]]
            left = left[~same & (found >= 0)]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        return out


class Lattices:
    """The lattices of many words, side by side.

    A node is a cut in a word. Nodes are numbered by their place in the word and
    then by the word (longest first), so an arc leads to a higher number, and a
    place is worked on in all words at once.
    """

    def __init__(self, words: list[bytes], pieces: Pieces) -> None:
        self.order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        size = np.array([len(words[i]) + 1 for i in self.order], np.int64)  # with the blank before
        deep = int(size[0])
        alive = np.searchsorted(-size, -np.arange(1, deep + 1), side="right")  # words that have a byte at the place
        start = np.concatenate([[0], np.cumsum(alive)])
        place = np.repeat(np.arange(deep), alive)
        word = np.arange(len(place)) - start[place]
        text = np.frombuffer(b"".join(b" " + words[i] for i in self.order), np.uint8)
        byte = text[(np.cumsum(size) - size)[word] + place]
        #: the first node of every place; the node before byte b of word w is first[b] + w
        self.first = np.concatenate([[0], len(words) + start])
        self.ends = self.first[size] + np.arange(len(words))

        node = np.zeros(len(place), np.int32)
        found = [(place, word, 1, len(pieces.spelt) + byte.astype(np.int64))]  # every byte by itself
        for k in range(pieces.longest):
            ok = place + k < size[word]
            node, place, word = node[ok], place[ok], word[ok]
            node = pieces.step(node, byte[start[place + k] + word])
            ok = node > 0
            node, place, word = node[ok], place[ok], word[ok]
            hit = pieces.piece[node]
            ok = hit >= 0
            found.append((place[ok], word[ok], k + 1, hit[ok].astype(np.int64)))
        self.word = np.concatenate([w for _, w, _, _ in found])
        self.frm = np.concatenate([self.first[b] + w for b, w, _, _ in found]).astype(np.int32)
        self.to = np.concatenate([self.first[b + k] + w for b, w, k, _ in found]).astype(np.int32)
        self.what = np.concatenate([x for _, _, _, x in found])
        self.ahead = self._sorted(self.frm, self.to)

    @staticmethod
    def _sorted(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
        """The order of the arcs by target; their sources; where a target's arcs begin; these targets."""
        order = np.argsort(target)
        target = target[order]
        head = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        return order, source[order], np.append(head, len(target)), target[head]

    def _swept(self, arcs: tuple[np.ndarray, ...], weight: np.ndarray, begin: np.ndarray, places: Iterator[int]) -> np.ndarray:
        """The log sum over all paths that lead from the nodes in `begin` to each node, place by place."""
        order, source, head, targets = arcs
        weight, out = weight[order], np.full(self.first[-1], -np.inf)
        out[begin] = 0.0
        bounds = np.searchsorted(targets, self.first)
        for j in places:
            lo, hi = bounds[j], bounds[j + 1]
            if lo == hi:
                continue
            a, b = head[lo], head[hi]
            value, cuts = out[source[a:b]] + weight[a:b], head[lo:hi] - a
            top = np.maximum.reduceat(value, cuts)
            value -= np.repeat(top, np.diff(head[lo : hi + 1]))
            out[targets[lo:hi]] = top + np.log(np.add.reduceat(np.exp(value), cuts))
        return out

    def _forward(self, log_share: np.ndarray) -> np.ndarray:
        return self._swept(self.ahead, log_share[self.what], np.arange(self.first[1]), range(1, len(self.first) - 1))

    def marginals(self, log_share: np.ndarray) -> np.ndarray:
        """The natural log of every word's probability, in the order the words came."""
        out = np.empty(len(self.order))
        out[self.order] = self._forward(log_share)[self.ends]
        return out

    def expected(self, log_share: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of every piece and single byte (the end: none) over all segmentations of the words, each taken so many times."""
        alpha, weight = self._forward(log_share), log_share[self.what]
        beta = self._swept(self._sorted(self.to, self.frm), weight, self.ends, range(len(self.first) - 3, -1, -1))
        share = np.exp(alpha[self.frm] + weight + beta[self.to] - alpha[self.ends][self.word])
        return np.bincount(self.what, share * counts[self.order][self.word], minlength=len(log_share))


_held: dict[str, tuple] = {}


class _Shared:
    """A broadcast that a worker unpacks once, by a name that no other has."""

    def __init__(self, spark: SparkSession, value: tuple) -> None:
        self.sent, self.name = spark.sparkContext.broadcast(value), uuid.uuid4().hex

    def get(self, make: Callable[[tuple], tuple] = lambda v: v) -> tuple:
        if self.name not in _held:
            _held.clear()
            _held[self.name] = make(self.sent.value)
        return _held[self.name]


def word_counts(docs: DataFrame) -> DataFrame:
    """docs(text as binary, train) -> (word, train, total): occurrences in the training rows and in all; the end is the empty word."""

    def handed(train: Counter, held: Counter) -> Iterator[pa.RecordBatch]:
        words = [*train, *(w for w in held if w not in train)]
        for lo in range(0, len(words), 1 << 15):
            some = words[lo : lo + (1 << 15)]
            a = [train[w] for w in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array(a, pa.int64()), pa.array([x + held[w] for x, w in zip(a, some, strict=True)], pa.int64())], names=["word", "train", "total"])
        train.clear()
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = (Counter(), Counter())
        for part in sliced(batches, size=4 << 20):
            for raw, learn in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                counter = counters[not learn]
                for words in word_pieces(raw, FOLD):
                    counter.update(words)
                    if sum(map(len, counters)) > TABLE:
                        yield from handed(*counters)
                counter[END] += 1
        yield from handed(*counters)

    found = docs.select("text", "train").mapInArrow(run, "word binary, train long, total long")
    return found.groupBy("word").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))


def _lattices(batch: pa.RecordBatch, pieces: Pieces) -> Iterator[tuple[pa.RecordBatch, Lattices]]:
    """The rows of a batch of words in slices of about BATCH bytes, the end left out."""
    size = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False)
    batch, size = batch.filter(pa.array(size > 0)), size[size > 0]
    group = (np.cumsum(size + 1) - size) // BATCH
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(size) else np.zeros(1, int)
    for lo, hi in pairwise(cuts.tolist()):
        part = batch.slice(lo, hi - lo)
        yield part, Lattices(part.column(0).to_pylist(), pieces)


def fitted(counts: DataFrame, pieces: Pieces, prior: float = PRIOR) -> np.ndarray:
    """Log shares of the pieces: their expected counts over all segmentations of the training words, weighed by the given shares, and `prior` counts of the latter."""
    shared = _Shared(counts.sparkSession, (pieces,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (pieces,) = shared.get()
        total = np.zeros(len(pieces.log_share))
        for b in batches:
            for part, lattices in _lattices(b, pieces):
                total += lattices.expected(pieces.log_share, part.column(1).to_numpy().astype(float))
        relax()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "n"])

    out = prior * np.exp(pieces.log_share)
    learned = counts.where("train > 0")
    for piece, n in learned.select("word", "train").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n")).collect():
        out[piece] += n
    for (n,) in learned.where(F.length("word") == 0).select("train").collect():
        out[pieces.end] += n
    return np.log(out / out.sum())


@dataclass
class Facts:
    """Tokens and distinct tokens of the training rows, with the end."""

    tokens: int
    distinct: int

    def base(self, train: Column) -> Column:
        return F.log10((train + F.lit(0.1)) / F.lit(self.tokens + 0.1 * (self.distinct + 1)))


def word_scores(counts: DataFrame, pieces: Pieces, model: np.ndarray, facts: Facts, discount: float = DISCOUNT) -> DataFrame:
    """(word, total, known, base, score, given) of every distinct word, in log10."""
    shared = _Shared(counts.sparkSession, (pieces, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, model = shared.get()
        for b in batches:
            for part, lattices in _lattices(b, pieces):
                spelt, train = lattices.marginals(model), part.column(1).to_numpy().astype(float)
                if facts.tokens:
                    with np.errstate(divide="ignore"):
                        arc, rest = np.log(np.maximum(train - discount, 0) / facts.tokens), np.log(discount * (facts.distinct - 1) / facts.tokens)
                    spelt = np.logaddexp(arc, rest + spelt)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spelt / LOG10), pa.array(lattices.marginals(pieces.log_share) / LOG10)], names=["word", "train", "total", "score", "given"])
        relax()

    made = counts.mapInArrow(run, "word binary, train long, total long, score double, given double")
    return made.select("word", "total", (F.col("train") > 0).cast("long").alias("known"), facts.base(F.col("train")).alias("base"), "score", "given")


NUMBERS = ["known", "base", "score", "given"]


def frequent(words: DataFrame) -> tuple[int, list]:
    """The least number of occurrences, a power of two, at which a word is broadcast, and these words: as many as FREQUENT and FREQUENT_BYTES admit."""
    level = F.floor(F.log2("total")).cast("int")
    held = words.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("size")).collect()  # a row for each power of two
    least, n, size = 1 << 62, 0, 0
    for r in sorted(held, reverse=True):
        n, size = n + r["n"], size + r["size"]
        if n > FREQUENT or size > FREQUENT_BYTES:
            break
        least = 1 << r["level"]
    return least, words.where(F.col("total") >= least).select("word", *NUMBERS).collect()


def scored(docs: DataFrame, words: DataFrame, ends: list[float], keep: Scratch) -> DataFrame:
    """docs(doc_id, held_out, text) -> (doc_id, held_out, tokens, known, base, score, given). ends: the numbers of the end."""
    least, table = frequent(words)
    shared = _Shared(docs.sparkSession, ([bytes(r["word"]) for r in table], np.array([[r[c] for c in NUMBERS] for r in table], float).reshape(-1, len(NUMBERS))))
    fields = [T.StructField("row", T.LongType()), docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("tokens", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in NUMBERS]]
    rare = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("k", T.LongType())]))
    schema = T.StructType([*fields, T.StructField("rare", rare)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, numbers = shared.get(lambda v: ({w: i for i, w in enumerate(v[0])}, v[1]))
        get = index.get
        for part in sliced(batches, size=4 << 20):
            at, tokens, sums, others = [], [], [], []

            def add(i: int, k: int, total: np.ndarray, rare: dict[bytes, int], to: tuple[list, ...] = (at, tokens, sums, others)) -> None:
                for held, x in zip(to, (i, k, total, [{"word": w, "k": n} for w, n in rare.items()]), strict=True):
                    held.append(x)

            for i, raw in enumerate(part.column("text").to_pylist()):
                k, total, rare = 1, np.array(ends), Counter()
                for some in word_pieces(raw, FOLD):
                    found = np.fromiter((get(w, -1) for w in some), np.int64, len(some))
                    total = total + numbers[found[found >= 0]].sum(axis=0)
                    k += len(some)
                    rare.update([some[j] for j in np.flatnonzero(found < 0).tolist()])
                    if len(rare) > RARE:  # a very long text goes on in further rows
                        add(i, k, total, rare)
                        k, total, rare = 0, np.zeros(len(NUMBERS)), Counter()
                add(i, k, total, rare)
            taken = part.select(["row", "doc_id", "held_out"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(tokens, pa.int64()), *[pa.array(x) for x in np.array(sums).T], pa.array(others, pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())])))], names=schema.names)

    parts = keep(docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text").mapInArrow(run, schema), "lm-parts")
    each = parts.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    looked = each.join(words.where(F.col("total") < least), "word").groupBy("row").agg(*[F.sum(F.col(c) * F.col("k")).alias(c) for c in NUMBERS])
    both = parts.drop("rare").unionByName(looked, allowMissingColumns=True)
    out = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("tokens").alias("tokens"), *[F.sum(c).alias(c) for c in NUMBERS])
    return out.drop("row")


def score(docs: DataFrame, model: str | Pieces = MODEL, folds: int = 10, prior: float = PRIOR, discount: float = DISCOUNT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, vocabulary_score) of every document; rows of fold 0 are held out."""
    small_batches(docs.sparkSession)
    fold = fold_of(F.col("doc_id"), folds)
    rows = docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.coalesce(fold != 0, F.lit(False)).alias("train"), F.col("text").cast("binary").alias("text"))
    pieces = model if isinstance(model, Pieces) else Pieces(model)
    with Scratch() as keep:
        counts = keep(word_counts(rows), "lm-counts")
        found = counts.agg(F.sum("train").alias("n"), F.count_if(F.col("train") > 0).alias("v"), F.max(F.when(F.length("word") == 0, F.col("train"))).alias("ends")).first()
        facts, ended = Facts(found["n"] or 0, found["v"]), found["ends"] or 0
        shares = fitted(counts, pieces, prior)
        words = keep(word_scores(counts, pieces, shares, facts, discount), "lm-words")
        end = [float(ended > 0), float(np.log10((ended + 0.1) / (facts.tokens + 0.1 * (facts.distinct + 1)))), float(np.log10(ended / facts.tokens) if ended else shares[pieces.end] / LOG10), float(pieces.log_share[pieces.end] / LOG10)]
        done = scored(rows, words, end, keep)
        return stored(done.select(
            "doc_id", "held_out", F.col("tokens").alias("n_tokens"), F.round("known").cast("long").alias("n_known"), F.lit(facts.tokens).cast("long").alias("train_tokens"),
            F.col("base").alias("base_score"), "score", F.col("given").alias("vocabulary_score"),
        ), "lm-scores")
