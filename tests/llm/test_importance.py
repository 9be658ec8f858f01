"""Importance resampling against features built as strings, and the cases that must not break it."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import importance as I
from tracemill.llm.batches import word_pieces
from tracemill.session import Scratch

from .test_ops import ODD, docs, odd

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, target, share=5):
    """rows (doc_id, text) -> doc_id, n_features, weight, score, rank."""
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    size, of = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (size + 10_000) / ((s[b] + 1) * (of + 10_000)))) for b in range(10_000)]
    out = []
    for doc_id, text in rows:
        n, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    best = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(best):
        r[4] = k + 1 if k < share * len(best) // 100 else None
    chosen = {id(r) for r in best}
    return [(*r[:4], r[4] if id(r) in chosen else None) for r in out]


def rows_of(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("few", [1, 500_000])
def test_against_strings(spark, sf, monkeypatch, few):
    monkeypatch.setattr(I, "RANGE", few)  # ranges of one candidate, or one range
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = rows_of(I.resample(d, b, share=20))
    assert got == sorted(brute([(r["doc_id"], r["text"]) for r in d.collect()], [r["text"] for r in b.collect()], 20), key=repr)
    assert sum(r[4] is not None for r in got) > 20


def test_words_in_pieces():
    rng = random.Random(1)
    text = "".join(rng.choice("aB9 .é漢_\n\x7f") for _ in range(5000)).encode()
    whole = WORD.findall(text.decode().translate(LOWER))
    for size in (1, 7, 1000, 10_000):
        parts = list(word_pieces(text, I.FOLD, size))
        assert [w.decode() for p in parts for w in p] == whole
        states, found = [], []
        for p in parts:
            more, states = I.ring(p, states)
            found += more
        assert sorted(x % 10_000 for x in found) == sorted(features(text.decode())[1])
    assert I.ring([], [])[0] == [] and I.ring([b"a"], [], 1)[0] == [zlib.crc32(b"a")]


def test_ties_go_by_id(spark):
    rows = spark.createDataFrame([(i, 30, 100 + (i % 2)) for i in range(40)] + [(None, 30, 101), (50, 3, 999)], "doc_id long, n_words long, score long")
    with Scratch() as keep:
        got = {r["doc_id"]: r["rank"] for r in I.drawn(rows.repartition(5), keep, 60).collect()}
    best = [*range(1, 40, 2), None, *range(0, 40, 2)][: 60 * 41 // 100]
    assert {k: v for k, v in got.items() if v} == {d: i + 1 for i, d in enumerate(best)} and got[50] is None and len(got) == 42


def test_odd_rows(spark):
    target = spark.createDataFrame([("word tie",), (None,), ("",)], "text string")
    given = [(r["doc_id"], r["text"]) for r in odd(spark).collect()]
    got = rows_of(I.resample(odd(spark).withColumn("n_words", F.lit(1)).withColumn("bucket", F.lit(2)), target, share=60))
    assert got == sorted(brute(given, ["word tie", None, ""], 60), key=repr)
    assert len(got) == len(ODD) + 3 and [r for r in got if r[0] is None][0][1:3] == (0, 0)
    assert rows_of(I.resample(odd(spark).limit(0), target)) == []
    none = rows_of(I.resample(docs(spark, ["a b", "c"]), target.limit(0)))
    assert none == sorted(brute([(0, "a b"), (1, "c")], []), key=repr)


def test_draw_leans_to_the_target(spark):
    rng = random.Random(4)
    words = lambda kind, n: " ".join(f"{kind}{int(rng.paretovariate(0.6)) % 300}" for _ in range(n))
    rows = [(i, words("near" if i % 10 == 0 else "far", 60)) for i in range(600)]
    target = spark.createDataFrame([(words("near", 400),)], "text string")
    got = I.resample(spark.createDataFrame(rows, "doc_id long, text string"), target).where("rank is not null").collect()
    assert len(got) == 30 and np.mean([r["doc_id"] % 10 == 0 for r in got]) > 0.9
