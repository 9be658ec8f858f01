"""The ten operators against brute force, exact round trips or held-out accuracy, with the cases that must not break them."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracemill.llm import components as comp
from tracemill.llm import decontaminate, language_id, line_dedup, quality, secret_scan, sentencepiece_scan, sharding, simhash_dedup, topk, warc
from tracemill.llm.queries import QUERIES

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "word", "Ünïcode 漢字 🙂 text", "a " * 30000, "x" * 20000, "tie tie tie", "tie tie tie"]


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", 0) for i, t in enumerate(texts)], DOC)


def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    d = docs(spark, ODD)
    more = spark.createDataFrame([(None, None, None, None, None), (7, "tie tie tie", None, None, None), (7, "tie tie tie", None, None, None)], DOC)
    return d.union(more).withColumn("score", F.lit("x")).withColumn("shard", F.lit(1)).withColumn("fp", F.lit(2)).withColumn("pos", F.lit(3)).withColumn("key", F.lit(4)).withColumn("gone", F.lit(5))


def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# ---- components ---------------------------------------------------------

def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(5, 5), (1, 0)]
    root = {x: x for ab in links for x in ab}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["comp"] for r in comp.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert comp.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 language ---------------------------------------------------------

def test_language_held_out(spark, sf):
    d = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    rows = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd(spark, sf):
    out = language_id.identify(real(spark, sf).unionByName(odd(spark).select(real(spark, sf).columns)))
    assert out.count() == real(spark, sf).count() + len(ODD) + 3
    got = language_id.identify(odd(spark)).collect()
    by = {(r["doc_id"], r["lang_pred"]) for r in got}
    assert len(got) == len(ODD) + 3 and (0, "und") in by and (1, "und") in by and (2, "und") in by and (None, "und") in by and (3, "en") in by
    assert language_id.identify(odd(spark).limit(0)).count() == 0


def test_language_parallel_windows():
    w, held = language_id.cut(b"A" * 600)
    assert w.shape == (3, 256) and held.tolist() == [256, 256, 88] and (w[0] == ord("a")).all() and (w[2, 88:] == 0).all()


# ---- 2 lines ------------------------------------------------------------

def lev(a, b):
    p = list(range(len(b) + 1))
    for i, c in enumerate(a):
        q = [i + 1]
        for j, d in enumerate(b):
            q.append(min(p[j] + (c != d), p[j + 1] + 1, q[-1] + 1))
        p = q
    return p[-1]


def similar(a, b):
    return abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and lev(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9)


def brute_lines(texts):
    """Groups of lines by definition: pairs that agree in two blocks and are similar enough."""
    lines = [(d, p, x, line_dedup.normal(x)) for d, t in enumerate(texts) if t for p, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[3]]
    norms = sorted({x[3] for x in lines})
    keys, sims = {}, {}
    for n in norms:
        _, _, _, s, k, _ = line_dedup.hashed_lines([n])
        keys[n], sims[n] = set(k.tolist()), s.view(np.uint64)
    root = {n: n for n in norms}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(norms):
        for b in norms[i + 1 :]:
            if keys[a] & keys[b] and line_dedup.apart(sims[a], sims[b])[0] <= line_dedup.FAR and similar(a, b):
                root[find(a)] = find(b)
    first = {}
    for d, p, _, n in lines:
        first.setdefault(find(n), []).append((d, p))
    return norms, find, first, lines


def varied(rng, vocab, lengths, n):
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice(lengths))) for _ in range(n)]

    def vary(x):
        w = x.split(" ")
        for _ in range(rng.randint(0, max(1, len(w) // 8))):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        return " ".join(w).upper() + rng.choice(["", ".", "!"])

    return base, vary


@pytest.mark.parametrize("small", [8, 2])
def test_lines_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    monkeypatch.setattr(line_dedup, "CHUNK", 16)
    monkeypatch.setattr(line_dedup, "NEAR", 16)
    rng = random.Random(3)
    base, vary = varied(rng, [f"word{i}" for i in range(60)], range(1, 41), 40)
    texts = ["\n".join(vary(rng.choice(base)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    _, find, first, lines = brute_lines(texts)
    d = docs(spark, texts)
    th = {r["doc_id"]: r["h"] for r in d.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    keep = {g: min(v, key=lambda x: (x[0], th[x[0]], x[1])) for g, v in first.items()}
    want, holders = {}, {}
    for dd, p, x, n in lines:
        if keep[find(n)] == (dd, p):
            want.setdefault(dd, []).append(x)
        else:
            holders.setdefault(dd, set()).add(keep[find(n)][0])
    rows = line_dedup.dedup(d, keep_emptied=True).collect()
    assert {r["doc_id"]: r["text"] for r in rows if r["text"] is not None} == {k: "\n".join(v) for k, v in want.items()}
    assert {r["doc_id"]: set(r["keepers"]) for r in rows if r["dropped_lines"]} == holders and len(rows) == len(texts)
    if small == 8:
        shuffled = {r["doc_id"]: r["text"] for r in line_dedup.dedup(d, broadcast_bytes=-1).collect()}
        assert shuffled == {k: "\n".join(v) for k, v in want.items()} and len(keep) < len(lines)


def test_lines_recall(spark):
    """Of all pairs of lines with an edit similarity of 0.8 or more, nine in ten are found: by the distance alone, without the operator's blocks."""
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.choice([2, 3, 5, 6, 7, 8, 10]))) for _ in range(3000)]
    base, vary = varied(rng, vocab, [4, 6, 8, 10, 12, 16, 20, 30, 45, 70, 120], 400)
    pairs = [(x.upper(), vary(x)) for x in base]
    pairs = [(a, b) for a, b in pairs if line_dedup.normal(a) != line_dedup.normal(b) and similar(line_dedup.normal(a), line_dedup.normal(b))]
    texts = [x for p in pairs for x in p]
    gone = {r["doc_id"] for r in line_dedup.dedup(docs(spark, texts), keep_emptied=True).where("dropped_lines = 1").collect()}
    print(len(gone), len(pairs))
    assert len(pairs) > 200 and len(gone) >= 0.9 * len(pairs) and all(i % 2 for i in gone)


def brief_pairs(rng, vocab, words, kind, n=300):
    """Lines of so many words and variants: a word replaced, added or dropped, or letters changed; those that are similar enough by edit distance alone."""
    out = []
    for _ in range(n):
        a = [rng.choice(vocab) for _ in range(rng.choice(words))]
        b = list(a)
        at = rng.randrange(len(b))
        if kind == "word":
            b[at:at + 1] = rng.choice([[rng.choice(vocab)], [b[at], rng.choice(vocab)], []])
        else:
            for _ in range(rng.randint(1, kind)):
                at, letters = rng.randrange(len(b)), rng.choice("abcdefgh")
                k = rng.randrange(len(b[at]))
                b[at] = b[at][:k] + rng.choice([letters, letters + b[at][k], ""]) + b[at][k + 1:]
            b = [x for x in b if x]
        a, b = " ".join(a), " ".join(b)
        if b and a != b and similar(a, b):
            out.append((a, b))
    return out


@pytest.mark.parametrize("words, kind", [([2], 1), ([3, 4], 1), ([3, 4], "word"), ([5, 6], "word"), ([7, 8, 9], "word"), ([5, 6, 7, 8, 9], 2), ([10, 11, 12], "word")])
def test_recall_of_brief_lines(words, kind):
    """Nine in ten pairs of 2 to 12 words meet under some key, in every length class."""
    rng = random.Random(str((words, kind)))
    vocab = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.choice([2, 3, 4, 5, 6, 7, 8, 10]))) for _ in range(3000)]
    pairs = brief_pairs(rng, vocab, words, kind, 2000 if kind == "word" and words[0] < 5 else 300)
    met = 0
    for a, b in pairs:
        (_, _, _, s, k, _), (_, _, _, t, m, _) = (line_dedup.hashed_lines([x]) for x in (a, b))
        met += bool(set(k.tolist()) & set(m.tolist())) and line_dedup.apart(s.view(np.uint64), t.view(np.uint64))[0] <= line_dedup.FAR
    print(words, kind, met, len(pairs))
    assert len(pairs) > 40 and met >= 0.9 * len(pairs)


def test_word_bound_and_edits():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice(["ab", "abc", "b", "cc"]) for _ in range(rng.randint(1, 8))]
        b = [x for x in a if rng.random() > 0.2] + [rng.choice(["b", "dd"])] * rng.randint(0, 2)
        x, y = " ".join(a), " ".join(b)
        d = lev(x, y)
        assert line_dedup.edits(x, y, 99) == d
        for most in range(d):
            assert not line_dedup.replaced(x.split(" "), y.split(" "), most)
        assert line_dedup.alike(x, y, 0.8) == similar(x, y)


def test_bigram_bound():
    """No pair that is similar enough is ruled out, and most others are."""
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    lines = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    for x in lines[:60]:
        w = list(x)
        for _ in range(rng.randint(1, max(1, len(w) // 5))):
            w[rng.randrange(len(w))] = rng.choice("abc ")
        lines.append("".join(w))
    lines += ["", "a", "b" * 70_000]
    counts, size = line_dedup.bigrams(lines)
    out = ruled = 0
    for x in range(len(lines) - 1):
        ok = line_dedup.reachable(counts, size, x, np.arange(len(lines)), 0.8)
        for y in range(len(lines) - 1):
            alike = similar(lines[x], lines[y])
            assert ok[y] or not alike, (lines[x], lines[y])
            out += not alike
            ruled += not ok[y]
    assert ruled > 0.5 * out


def test_lines_odd(spark):
    many = odd(spark).withColumn("dropped_lines", F.lit("x")).withColumn("__gone", F.lit(1)).withColumn("__doc", F.lit(2)).withColumn("__th", F.lit(2))
    out = line_dedup.dedup(many)
    rows = out.collect()
    assert out.columns == [*many.drop("dropped_lines").columns, "dropped_lines", "keepers"]
    texts = [r["text"] for r in rows]
    assert texts.count(None) == 2 and "" in texts and " \n\t " in texts
    # one document of the tie stays: (7, ...) with its repeated rows; (8, ...) goes
    assert sorted(r["doc_id"] for r in rows if r["text"] == "tie tie tie") == [7, 7, 7]
    assert line_dedup.dedup(odd(spark).limit(0)).count() == 0


def test_lines_without_blanks_and_short_ones(spark):
    chinese = "".join(chr(0x4E00 + i * 7) for i in range(60))
    texts = [chinese, chinese[:30] + "\u9fa0" + chinese[31:], "contact our office", "contact our offices", "other things", "ab", "ac"]
    gone = {r["doc_id"] for r in line_dedup.dedup(docs(spark, texts), keep_emptied=True).where("dropped_lines = 1").collect()}
    assert gone == {1, 3}


# ---- 3 top-k ------------------------------------------------------------

def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in rng.normal(0, 0.2, 16)]) for i in range(300)]
    data += [(300 + i, [0.1] * 16) for i in range(60)]  # ties
    data += [(400, None), (401, [float("nan")] * 16), (402, [None] + [0.1] * 15), (403, [float("inf")] * 16), (None, [0.2] * 16), (404, [0.3] * 4), (405, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("row", F.lit(2))
    ok = [(i, [int(np.floor(64.0 * float(np.float32(x)))) for x in v]) for i, v in data if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, v in ok:
        if q is not None and q % 20 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i is None, i or 0, i) for i, w in ok if i != q))[:20]
            want |= {(q, r + 1, i, -s) for r, (s, _, _, i) in enumerate(scored)}
    got = {tuple(r) for r in topk.top_k(df, query_group=7, row_group=50).collect()}
    assert got == want
    assert {tuple(r) for r in topk.top_k(df).collect()} == want
    assert topk.top_k(df.limit(0)).count() == 0


def test_topk_beyond_doubles():
    q, c = np.array([[1 << 30, 3]]), np.array([[1 << 30, 1], [1 << 30, 2], [5, 5]])
    (ids, scores), = topk.search(q, np.array([9]), c, np.array([0, 1, 2]), 2)
    assert ids.tolist() == [1, 0] and scores.tolist() == [(1 << 60) + 6, (1 << 60) + 3]


def test_topk_prunes(sf):
    """On real vectors a good part of the products is never computed, and the result is that of all of them."""
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf}/../sf0.1/embeddings.parquet")
    v = np.floor(64.0 * np.array(t["embedding"].to_pylist(), np.float64)).astype(np.int64)
    ids = t["vec_id"].to_numpy()
    asked = ids % 20 == 0
    tally = []
    got = topk.search(v[asked], ids[asked], v, ids, 20, tally)
    scores = v[asked] @ v.T
    for i, own in enumerate(ids[asked]):
        ok = np.flatnonzero(ids != own)
        pick = ok[np.lexsort((ids[ok], -scores[i, ok]))[:20]]
        assert got[i][0].tolist() == ids[pick].tolist() and got[i][1].tolist() == scores[i, pick].tolist()
    share = tally[0] / (v[asked].size * len(v))
    print("share of the products computed", share)
    assert share < 0.65


def test_topk_repeated_queries(spark):
    rows = [(20, [0.5, 0.1]), (20, [0.5, 0.1]), (20, [0.1, 0.5]), (21, [0.4, 0.4]), (22, None)]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    dot = lambda a, b: sum(int(np.floor(64 * x)) * int(np.floor(64 * y)) for x, y in zip(np.float32(a), np.float32(b), strict=True))
    assert got == sorted([(20, 1, 21, dot(rows[0][1], rows[3][1])), (20, 1, 21, dot(rows[2][1], rows[3][1]))])


# ---- 4 shards -----------------------------------------------------------

def brute_shards(rows, shards, virtual):
    """Row by row around the ring: first what its own shard has room for, then, point by point, what is left over."""
    def content(row):
        h = 42
        for x in row:
            h = h if x is None else xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), seed=h)
        return h - (1 << 64) if h >> 63 else h

    points = sharding.ring(shards, virtual)
    arcs = {}
    for row in rows:
        h = xxhash.xxh64_intdigest(("null" if row[0] is None else str(row[0])).encode(), seed=42)
        h = h - (1 << 64) if h >> 63 else h
        arcs.setdefault(sum(p < h for p, _ in points) % len(points), []).append(row)
    for x in arcs.values():
        x.sort(key=lambda row: (content(row), str(row)))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    given = {a: [] for a in arcs}
    for hop in range(len(points)):
        for a in sorted(arcs):
            s = points[(a + hop) % len(points)][1]
            while room[s] and len(given[a]) < len(arcs[a]):
                given[a].append(s)
                room[s] -= 1
    slots, out = [0] * shards, []
    for a in sorted(arcs):
        for row, s in zip(arcs[a], given[a], strict=True):
            out.append((*row, s, slots[s]))
            slots[s] += 1
    return out


def test_shards(spark, sf):
    d = real(spark, sf).unionByName(odd(spark).select(real(spark, sf).columns))
    d = d.union(docs(spark, ["hot"] * 400, [77] * 400))
    out = sharding.assign(d.repartition(6)).collect()
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(out) == d.count() and len(by) == 8 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in out)
    null = next(r for r in out if r["doc_id"] is None)
    assert null["size"] == 1 and null["text_crc32"] == 0
    sizes = sorted((len((x["text"] or "").encode()) + 1, zlib.crc32((x["text"] or "").encode())) for x in d.select("text").collect())
    assert sizes == sorted((r["size"], r["text_crc32"]) for r in out)
    every = sorted(map(str, out))
    assert sorted(map(str, sharding.assign(d.repartition(3)).collect())) == every
    for parts in (2, 5):  # cells of 20 rows, so that those of the hot row are divided
        assert sorted(map(str, sharding.assign(d.repartition(parts), target=20).collect())) == every
    rows = [(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in d.select("doc_id", "text").collect()]
    assert sorted(brute_shards(rows, 8, 64), key=str) == sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in out), key=str)
    assert sharding.assign(d.limit(0)).count() == 0 and sharding.assign(d.limit(3)).count() == 3


def test_ring_moves_little():
    before, after = sharding.ring(8, 64), sharding.ring(9, 64)
    assert [x for x in after if x[1] < 8] == before
    goes = sharding.walk({0: 10, 1: 1}, [0, 1, 0, 1], [6, 5])
    assert goes == {0: [(0, 6), (1, 4)], 1: [(1, 1)]}
    # a ninth shard: most rows stay where they are, as bounded loads allow
    rows = [(i, 1 + i % 7, i * 31) for i in range(6000)]
    here, there = ({r[0]: r[3] for r in brute_shards(rows, n, 64)} for n in (8, 9))
    moved = [i for i in here if here[i] != there[i]]
    assert len(moved) < 0.2 * len(rows) and sum(there[i] != 8 for i in moved) < 0.08 * len(rows)


# ---- 5 WARC -------------------------------------------------------------

def test_warc(spark, tmp_path):
    data = [(i, f"http://a/{i}", "<p>same</p>" if i % 3 == 0 else f"<p>é {i}</p>") for i in range(40)]
    data += [(50, None, None), (51, "http://x/\r\nevil: 1", ""), (None, "u", "<p>same</p>"), (7, "http://a/7", "<p>é 7</p>"), (60, "http://b", "z" * 300000), (1 << 40, "far", "f")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("shard", F.lit(1)).withColumn("sha1", F.lit("x"))
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    manifest = warc.write(pages, one, shard_bytes=2000, roll_bytes=500).collect()
    warc.write(pages.repartition(5), two, shard_bytes=2000, roll_bytes=500)
    files = sorted(p.name for p in (tmp_path / "one").glob("*.gz"))
    assert files == sorted(m["file"] for m in manifest) and len(files) > 4 and not list((tmp_path / "one").glob("_temporary*"))
    for name in files:
        assert (tmp_path / "one" / name).read_bytes() == (tmp_path / "two" / name).read_bytes()
    for m in manifest:
        assert hashlib.sha1((tmp_path / "one" / m["file"]).read_bytes()).hexdigest() == m["sha1"]
    rows = warc.read(spark, one).collect()
    assert len(rows) == len(data)
    payload = lambda h: (h or "").encode()
    largest = {}
    for i, _, h in data:
        largest[payload(h)] = max(largest.get(payload(h), -1), -1 if i is None else i)
    want = sorted((str(i), len(payload(h)), base64.b32encode(hashlib.sha1(payload(h)).digest()).decode(), "response" if i == largest[payload(h)] else "revisit", None if i == largest[payload(h)] else largest[payload(h)]) for i, _, h in data)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows) == want
    assert all(bytes(r["payload"]) == payload(h) for r in rows for i, _, h in data if r["record_type"] == "response" and r["page_id"] == i)
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("literals", [4096, 9, 1])
def test_one_shard_a_partition(spark, monkeypatch, literals):
    """By literals or in two steps, every page is in the shard that its id falls into, and every shard in a partition of its own."""
    monkeypatch.setattr(warc, "LITERALS", literals)
    for n in (1, 7, 64):
        starts = [10 * k + 3 for k in range(1, n)]
        ids = [None, *range(-5, 10 * n + 20)]
        rows = warc.placed(spark.createDataFrame([(k,) for k in ids], "page_id long"), starts).repartition(n, "dealt").select("page_id", "shard", F.spark_partition_id().alias("p")).collect()
        assert sorted((str(r["page_id"]), r["shard"]) for r in rows) == sorted((str(k), 0 if k is None else sum(s <= k for s in starts)) for k in ids)
        assert len({r["p"] for r in rows}) == n == len({(r["p"], r["shard"]) for r in rows})


def test_warc_notices_damage():
    good = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert warc.parse(good)[2] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"abc", b"abd"))


# ---- 6 near-duplicates --------------------------------------------------

def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(ids, fps, distance=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash_against_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in real(spark, sf).collect()] + [(r["doc_id"], r["text"]) for r in odd(spark).collect()]
    rows = [(i if k < 200 or i is None else 1000 + i, t) for k, (i, t) in enumerate(rows)]
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted(zip([str(i) for i, _ in rows], fps, brute_groups([i for i, _ in rows], fps), strict=True), key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1))
    got = sorted(((str(r["doc_id"]), r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash_dedup.near_duplicates(df).collect()), key=str)
    assert got == want


def test_text_hash_in_pieces():
    from tracemill.llm.text_hash import simhashes

    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)
    cuts = np.array([0, 1, 4, 259, 260, 1400, 1655, 3000])
    want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[lo:hi]) > hi - lo) for lo, hi in zip(cuts[:-1], cuts[1:])]
    assert simhashes(h, cuts[:-1], cuts[1:]).tolist() == want


@pytest.mark.parametrize("limit", [256, 2])
def test_simhash_links(spark, limit):
    """All links within two bits, by pairs and, for common keys, by midpoints."""
    rng = random.Random(limit)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(60)})
    table = spark.createDataFrame([(simhash_dedup._signed(x),) for x in fps], "fp long")
    links, _ = simhash_dedup._links(table, 2, 7, limit)
    got = {r["node"]: r["comp"] for r in comp.components(links).collect()}
    signed = [simhash_dedup._signed(x) for x in fps]
    want = dict(zip(signed, brute_groups(signed, fps), strict=True))
    assert {k: v for k, v in want.items() if k in got} == got and all(list(want.values()).count(want[x]) == 1 for x in signed if x not in got)
    for r in links.collect():
        assert ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 2


def test_keep_first(spark):
    words = " ".join(f"w{i}" for i in range(80))
    d = docs(spark, [words, words.upper(), words + " more", "other words are here", None, "", "other", "B"], [5, 3, 4, 9, 20, 21, 3, 3])
    assert sorted((r["doc_id"], r["text"]) for r in simhash_dedup.keep_first(d).collect() if r["text"]) == [(3, "B"), (3, words.upper()), (3, "other"), (9, "other words are here")]
    assert simhash_dedup.keep_first(d.limit(0)).count() == 0


# ---- 7 decontamination --------------------------------------------------

ITEM = "A train leaves Boston at 40 km per hour and another train follows from Boston after 3 hours at 70 km per hour; when does it overtake the first train"


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "tiny"), (4, "seven plain words make one short question")], "item_id long, text string")
    filler = "unrelated words go round and round here without any plan or aim at all"
    texts = {
        10: f"{filler} {ITEM} {filler}",
        11: f"{filler}. {ITEM.replace('Boston', 'Paris').replace('40', '55').replace('70', '90')} {filler}",
        12: ITEM.upper(),
        13: " ".join(ITEM.split()[:7]),
        14: filler,
        15: ITEM.replace("from Boston", "from Chicago").replace("leaves", "departs"),  # Boston stands for two values
        16: f"x {bench.collect()[3]['text']} y",
        17: None,
        18: "",
        19: ITEM.replace(" ", "\n  "),
    }
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("item_id", F.lit(0))
    got = {(r["doc_id"], r["item_id"]): (r["covered"], r["changed"]) for r in decontaminate.contaminated(d, bench).collect()}
    assert {k for k in got if k[1] == 1} >= {(10, 1), (11, 1), (12, 1), (19, 1)} and (16, 4) in got
    assert not {k for k in got if k[0] in (13, 14, 17, 18)}
    assert got[10, 1][1] == 0 and got[11, 1][1] > 0 and got[15, 1][0] < got[10, 1][0]
    slabs = {(r["doc_id"], r["item_id"]): (r["covered"], r["changed"]) for r in decontaminate.contaminated(d, bench, slab_bytes=40).collect()}
    assert slabs == got
    assert {r["doc_id"] for r in decontaminate.clean(d, bench).collect()} == {13, 14, 17, 18}
    assert decontaminate.contaminated(d, bench.limit(0)).count() == 0 and decontaminate.contaminated(d.limit(0), bench).count() == 0


def test_decontamination_finds_what_ngrams_find(spark, sf):
    from tracemill.operators.ngrams import contaminated_ids

    d, b = real(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = {r["doc_id"] for r in contaminated_ids(d, b, 13).collect()}
    assert plain and {r["doc_id"] for r in decontaminate.contaminated(d, b).collect()} == plain


# ---- 8 quality ----------------------------------------------------------

def test_quality_held_out(spark, sf):
    at = f"{sf}/../sf0.01"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    rows = quality.classify(spark.read.parquet(f"{at}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95 and {0, 1} == {r["predicted"] for r in rows}


def test_quality_odd(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    odd_labels = labels.union(spark.createDataFrame([(None, 1, 0), (3, None, None), (5, 0, 0), (5, 1, 0), (7, 1, 0), (7, 1, 0)], labels.schema))
    out = quality.classify(real(spark, sf).unionByName(odd(spark).select(real(spark, sf).columns)), odd_labels)
    assert out.count() == real(spark, sf).count() + len(ODD) + 3 and out.where("score < 0 or score > 1 or score is null or predicted is null").count() == 0
    none = quality.classify(odd(spark), labels.limit(0)).collect()
    assert len(none) == len(ODD) + 3 and {r["score"] for r in none} == {0.5}
    assert quality.classify(odd(spark).limit(0), labels).count() == 0


# ---- 9 secrets ----------------------------------------------------------

def brute_spans(text):
    out = []
    for no, (kind, pattern, least) in enumerate((("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", None), ("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24))):
        for m in re.finditer(pattern, text or "", re.A):
            if (len(m[2]) >= 6) if least is None else len(m[0]) >= least:
                out.append((m.start(), no, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


SECRETS = [
    "Password : 'hunter22' token=\"abc\" secret: token: abcdef",
    "🙂🙂 api_key=ABCDEF123 apikey:xxxxxx AKIA" + "A1" * 8 + " and AKIASHORT",
    "0123456789abcdef01234567 " + "f" * 23,
    "token=token=abcdefgh",
    "key q8Zt3LkVx91mPwR7sYb2Nc5Jd0GfHa6E done",
    "2024-01-01-2024-01-02-2024-01-03-2024-01-04 aaaa1aaaa1aaaa1aaaa1aaaa1",
]


def test_secrets(spark):
    texts = ODD + SECRETS
    df = docs(spark, texts).withColumn("t", F.lit(1)).withColumn("base", F.lit(2)).withColumn("runs", F.lit(3))
    got = {r["doc_id"]: r for r in secret_scan.digest(secret_scan.scan(df)).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        assert ",".join(x for x in got[i]["spans"].split(",") if not x.startswith("random")) == want
        assert got[i]["n_assign"] == want.count("assign") and got[i]["n_access"] == want.count("access") and got[i]["n_hex"] == want.count("hex")
    at = len(ODD)
    assert got[at + 4]["spans"] == "random:4:36" and "random" not in got[at + 5]["spans"]
    assert secret_scan.digest(secret_scan.scan(df.limit(0))).count() == 0


def test_false_discovery_control(spark):
    cells = spark.createDataFrame([(1, c) for c in [0] * 95 + [200] * 5], "level int, cell int")
    cut = secret_scan.thresholds(cells, 0.05)[1]
    assert 0 < cut <= 200
    assert secret_scan.thresholds(cells.where("cell = 0"), 0.05)[1] > secret_scan.DEEPEST


# ---- 10 SentencePiece ---------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.MODEL)


@pytest.fixture(scope="module")
def lattice():
    return sentencepiece_scan.Lattice(sentencepiece_scan.Vocabulary(sentencepiece_scan.MODEL))


ALPHABETS = ["ab the  \n", "aaaa b", "héllo wörld ñ日本🙂 \t<s>", "0123456789.,-", "   the in of ", "internationalization", "..,,!? a"]


def test_encoding_equals_the_library(library, lattice):
    rng = random.Random(9)
    for _ in range(600):
        text = "".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randint(0, 60)))
        want = library.encode(text)
        assert lattice.encode(sentencepiece_scan.surface(text)) == want
        assert lattice.decode(want) == library.decode(want)


def test_chunks_equal_one_pass(library, lattice):
    """Transfer matrices, multiplied in any grouping, and independent traces."""
    rng = random.Random(4)
    halo = lattice.v.longest
    for n in range(200):
        text = "".join(rng.choice(ALPHABETS[n % len(ALPHABETS)]) for _ in range(rng.randint(1, 80)))
        t, size = sentencepiece_scan.surface(text), rng.choice([3, 7, 20])
        parts = [(t[max(0, lo - halo) : lo], t[lo : lo + size], t[lo + size : lo + size + halo]) for lo in range(0, len(t), size)]
        ms = [lattice.matrix(*p) for p in parts]
        states = sentencepiece_scan._resolve(list(enumerate(ms)), sentencepiece_scan.START, None)
        assert sum((lattice.trace(*p, a, b) for p, (_, a, b) in zip(parts, states, strict=True)), []) == library.encode(text)
        if len(ms) > 2:
            left = ms[0]
            for m in ms[1:]:
                left = sentencepiece_scan.product(left, m)
            right = ms[-1]
            for m in ms[-2::-1]:
                right = sentencepiece_scan.product(m, right)
            assert left.keys() == right.keys() and all(left[k].keys() == right[k].keys() for k in left)


def test_sentencepiece_frames(spark, sf, library):
    df = odd(spark).unionByName(real(spark, sf), allowMissingColumns=True)
    out = sentencepiece_scan.decode(sentencepiece_scan.encode(df, chunk=1500))
    rows = out.collect()
    assert len(rows) == df.count() and out.columns == [*df.columns, "ids", "decoded"]
    for r in rows:
        assert r["ids"] == (None if r["text"] is None else library.encode(r["text"])) and r["decoded"] == r["text"]
    # in one go, into columns that are there already
    again = sentencepiece_scan.encode(out.withColumn("__key", F.lit(1)).withColumn("__ids", F.lit(2)), chunk=1500, decoded="decoded")
    assert again.columns == [*df.columns, "__key", "__ids", "ids", "decoded"]
    assert sorted(str((r["text"], r["ids"], r["decoded"])) for r in again.collect()) == sorted(str((r["text"], r["ids"], r["decoded"])) for r in rows)
    assert sentencepiece_scan.encode(df.limit(0)).count() == 0


# ---- queries and the pipeline -------------------------------------------

@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    d = real(spark, sf)
    stages = {}
    for name, stage in p.STAGES:
        d = stage(spark, d, sf).cache()
        stages[name] = d
        if name != "tokens":
            assert d.columns == list(p.COLUMNS)
    ids = {k: {r["doc_id"] for r in v.select("doc_id").collect()} for k, v in stages.items()}
    assert ids["tokens"] == ids["decontamination"] <= ids["near_duplicates"] <= ids["lines"] <= ids["quality"]
    assert stages["tokens"].where("not round_trip").count() == 0
    assert stages["lines"].where(F.col("n_chars") != F.char_length("text")).count() == 0
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(good & ids["quality"]) >= 0.97 * len(good)


def test_pipeline_of_nothing(spark, sf):
    import corpus_pipeline as p

    d = real(spark, sf).limit(0)
    for _, stage in p.STAGES:
        d = stage(spark, d, sf)
    assert d.count() == 0


def test_brief_lines_share_their_hashes(monkeypatch):
    """The words of a line that are hashed alike for several keys are hashed once, and the keys stay as they were."""
    calls, mix = [], line_dedup.mix
    monkeypatch.setattr(line_dedup, "mix", lambda h: calls.append(1) or mix(h))
    word = np.random.default_rng(3).integers(0, 1 << 63, 20).astype(np.uint64)
    size, first, words = np.arange(20) % 7 + 1, np.array([0, 10]), np.array([10, 10])
    got = sorted((int(r), int(k)) for rows, keys in line_dedup._without_words(word, size, first, words) for r, k in zip(rows, keys, strict=True))
    assert len(calls) <= 250  # 516 with a hash of its own for each key
    want = []
    for r in range(2):
        w, s = word[10 * r :][:10], size[10 * r :][:10]
        for gone in [(), *((i,) for i in range(10)), *((i, j) for j in range(10) for i in range(j))]:
            if len(gone) < 2 or s[list(gone)].sum() <= line_dedup.REST * s.sum():
                key = np.zeros(1, np.uint64)
                for k in range(10):
                    if k not in gone:
                        key = mix(key * np.uint64(31) + w[k])
                want.append((r, int(mix(key + np.uint64(77))[0])))
    assert got == sorted(want)


def test_equal_lines_of_a_task_have_keys_once():
    """Only the first of equal lines that a task meets brings keys; what it brings is what the line has by itself."""
    import pyarrow as pa

    texts = ["one line of some words here\nanother line of other words", "another line of other words\nONE line of some words, here!", "one line of some words here"]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([i]), pa.array([t])], names=["doc_id", "th", "text"]) for i, t in enumerate(texts)]
    rows = [r for b in line_dedup._lines(iter(batches)) for r in b.to_pylist()]
    assert [(r["doc_id"], r["pos"], bool(r["keys"])) for r in rows] == [(0, 0, True), (0, 1, True), (1, 0, False), (1, 1, False), (2, 0, False)]
    for r, line in zip(rows, texts[0].split("\n"), strict=False):
        _, _, lh, sim, keys, _ = line_dedup.hashed_lines([line])
        assert (r["lh"], r["sim"]) == (lh[0], sim[0]) and sorted(r["keys"]) == sorted(keys.tolist())


def test_buckets_with_repeats():
    """A line that comes into a bucket from several tasks counts once, and a key of one line gives nothing."""
    import pyarrow as pa

    def found(rows):
        b = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["k", "lh", "sim"])
        return [tuple(r.values()) for x in line_dedup._candidates(iter([b])) for r in x.to_pylist()]

    assert found([(1, 10, 1)] * 40 + [(1, 11, 1)] * 40 + [(2, 10, 1)] * 20 + [(3, 12, 1)]) == [(10, 11, None)]
    assert found([(1, 10, 1), (2, 10, 1)]) == []


def test_most_unlike_pairs_need_no_distance(monkeypatch):
    """Pairs whose characters rule them out aren't compared step by step; no pair that is similar enough is ruled out."""
    rng, calls, edits = random.Random(4), [], line_dedup.edits
    monkeypatch.setattr(line_dedup, "edits", lambda *x: calls.append(1) or edits(*x))
    assert not line_dedup.alike("the quick brown fox jumps", "zzzzz xxxxx vvvvv kkkkk w", 0.8) and not calls
    for _ in range(300):
        a = "".join(rng.choice("abcd é") for _ in range(rng.randint(1, 90)))
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 2)):
            b[rng.randrange(len(b))] = rng.choice(["", "b", "cd"])
        b = "".join(b)
        if b:
            d = lev(a, b)
            assert not line_dedup.unlike(a, b, d) and edits(a, b, d) == d and line_dedup.alike(a, b, 0.8) == similar(a, b)
