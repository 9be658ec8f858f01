"""Marginal probabilities against a recursion word by word and a listing of all segmentations, on both ways to look a word up."""

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import lattice_lm as L

from .test_ops import ODD, docs, odd

TINY = {b" a": 0.0, b" ab": -1.0, b"b": -2.0, b"ba": -3.0, b"a": -4.0, b" ": -5.0, b"abab": -6.0}


@pytest.fixture(scope="module")
def pieces():
    return L.Pieces(L.MODEL)


def paths(text, spelt):
    """All ways to write text as pieces or single bytes: lists of (piece or byte number)."""
    if not text:
        return [[]]
    out = [[("byte", text[0]), *rest] for rest in paths(text[1:], spelt)]
    return out + [[x, *rest] for x in spelt if text.startswith(x) for rest in paths(text[len(x) :], spelt)]


def test_all_segmentations_of_short_words():
    p = L.Pieces.of(TINY)
    number = {x: i for i, x in enumerate(p.spelt)}
    logs = lambda path: [p.log_share[len(TINY) + x[1] if isinstance(x, tuple) else number[x]] for x in path]
    assert np.exp(p.log_share).sum() == pytest.approx(1)
    words = [b"abab", b"a", b"bab", b"zz", b"abababa", b"a"]
    counts = np.array([3.0, 1, 2, 5, 1, 4])
    lattices = L.Lattices(words, p)
    want, uses = [], np.zeros(len(p.log_share))
    for w, c in zip(words, counts, strict=True):
        each = [math.exp(sum(logs(x))) for x in paths(b" " + w, TINY)]
        want.append(math.log(sum(each)))
        for path, v in zip(paths(b" " + w, TINY), each, strict=True):
            for x in path:
                uses[len(TINY) + x[1] if isinstance(x, tuple) else number[x]] += c * v / sum(each)
    assert np.allclose(lattices.marginals(p.log_share), want, rtol=1e-12)
    assert np.allclose(lattices.expected(p.log_share, counts), uses, rtol=1e-10, atol=1e-12)


def plain(p, word, shares):
    """Forward recursion of one word."""
    index = {x: i for i, x in enumerate(p.spelt)} if not hasattr(p, "index") else p.index
    p.index = index
    text = b" " + word
    ahead = [0.0]
    for j in range(1, len(text) + 1):
        arcs = [ahead[j - 1] + shares[len(p.spelt) + text[j - 1]]]
        arcs += [ahead[j - k] + shares[index[text[j - k : j]]] for k in range(1, min(j, p.longest) + 1) if text[j - k : j] in index]
        top = max(arcs)
        ahead.append(top + math.log(sum(math.exp(x - top) for x in arcs)))
    return ahead[-1]


def test_forward_of_real_words(pieces):
    words = [b"hello", "großartig—季".encode(), b"\xff\xfe", b"q", b"x" * 5000, b"the", "▁▁".encode()]
    got = L.Lattices(words, pieces).marginals(pieces.log_share)
    assert np.allclose(got, [plain(pieces, w, pieces.log_share) for w in words], rtol=1e-12)


def test_words_are_a_distribution(pieces):
    """The spellings of all words of up to two bytes, and all that go on, share the mass of a first piece."""
    tiny = L.Pieces.of({b" a": 0.0, b"b": -1.0})
    short = [bytes([a]) for a in range(256)] + [bytes([a, b]) for a in range(256) for b in range(256)]
    assert np.exp(L.Lattices(short, tiny).marginals(tiny.log_share)).sum() < 1


def brute(rows, p, prior=L.PRIOR, discount=L.DISCOUNT):
    words = lambda t: (t or "").encode().lower().split()
    fold = lambda i: crc32(str(i).encode()) % 10 if i is not None else None
    c = Counter(w for i, t in rows if fold(i) for w in [*words(t), b""])
    n, v = sum(c.values()), len(c)
    known = [w for w in c if w]
    share = prior * np.exp(p.log_share)
    if known:
        share += L.Lattices(known, p).expected(p.log_share, np.array([c[w] for w in known], float))
    share[p.end] += c[b""]
    share = np.log(share / share.sum())
    memo = {}

    def token(w):
        if not w:
            return math.log(c[w] / n) if c[w] else share[p.end]
        if w not in memo:
            memo[w] = plain(p, w, share)
            if n:
                arc = math.log((c[w] - discount) / n) if c[w] else -np.inf
                memo[w] = np.logaddexp(arc, math.log(discount * (v - 1) / n) + memo[w])
        return memo[w]

    out = []
    for i, t in rows:
        all_ = [*words(t), b""]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in all_)
        given = sum(plain(p, w, p.log_share) if w else p.log_share[p.end] for w in all_) / math.log(10)
        out.append((-1 if i is None else i, fold(i) == 0, len(all_), sum(c[w] > 0 for w in all_), n, base, sum(map(token, all_)) / math.log(10), given))
    return sorted(out)


def rows_of(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], *tuple(r)[1:]) for r in df.collect())


def close(got, want):
    assert [r[:5] for r in got] == [r[:5] for r in want]
    far = [(a, b) for a, b in zip(got, want, strict=True) if not np.allclose(a[5:], b[5:], rtol=1e-9)]
    assert not far


@pytest.mark.parametrize("few", [0, 8, 1 << 18])
def test_scores_against_brute_force(spark, monkeypatch, pieces, few):
    """No word broadcast, the most frequent ones, or all; counters and rows that overflow."""
    monkeypatch.setattr(L, "FREQUENT", few)
    texts = ["the cat sat on the mat", "The dog\tsat", "a zebra!", "the the the " * 50, None, "", " \n ", "naïve Straße 漢字", "cat cat dog"] * 5 + ["held out unseen words " + "z" * 300]
    d = docs(spark, texts).repartition(3)
    close(rows_of(L.score(d, pieces)), brute(list(enumerate(texts)), pieces))


def test_small_tables_and_rows(spark, monkeypatch, pieces):
    """Tables of few words and rows of few occurrences."""
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(200)) for i in range(1, 30)]
    want = brute(list(enumerate(texts)), pieces)
    for name, value in (("TABLE", 10), ("RARE", 7), ("FREQUENT", 5), ("BATCH", 64)):
        monkeypatch.setattr(L, name, value)
    close(rows_of(L.score(docs(spark, texts).repartition(4), pieces)), want)


def test_odd_rows(spark, pieces):
    d = odd(spark).withColumn("row", F.lit(1)).withColumn("train", F.lit("x")).withColumn("word", F.lit(None))
    got = rows_of(L.score(d, pieces))
    close(got, brute([(r["doc_id"], r["text"]) for r in d.collect()], pieces))
    assert len(got) == len(ODD) + 3 and L.score(d.limit(0), pieces).count() == 0
    held = [i for i in range(200) if crc32(str(i).encode()) % 10 == 0][:3]
    rows = list(zip(held, ["unseen", None, "a b"], strict=True))
    got = rows_of(L.score(docs(spark, [t for _, t in rows], held), pieces))
    close(got, brute(rows, pieces))
    assert all(r[4] == 0 and r[5] == 0 for r in got)


def test_held_out_text_is_likelier_than_under_the_given_shares(spark, sf, pieces):
    rows = L.score(spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), pieces).where("held_out").agg(*[F.sum(c) for c in ("n_tokens", "score", "vocabulary_score")]).first()
    assert rows[1] / rows[0] > -4.8 and rows[2] / rows[0] < -8
