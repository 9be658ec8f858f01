"""Fuzzy line dedup over all documents.

1. Every line is normalised (lower case, ASCII punctuation dropped, digits
   made 0, blanks collapsed) and hashed; its words make a 64-bit SimHash. One
   pass over the text, with numpy over whole batches.
2. Lines with equal normalised text are one node. A node also has a SimHash in
   five blocks: its words of LONG bytes or more (of a long line some SAMPLE of
   them, drawn by hash) are dealt to the blocks by hash, and each block is the
   SimHash of its own words. A replaced word touches two blocks at most, so by
   the pigeonhole principle three stay equal; nodes that agree in two blocks of
   LEAST words or more together are joined under that pair. Lines with few long
   words, or none (short lines, scripts without blanks), use GRAM-byte strings
   instead of words; around the boundary a line has both kinds of keys. Ten
   words are too few for blocks to stay equal, so lines of up to BRIEF words are
   also joined if they are equal but for one word, or two that are a small part
   of them; and those of up to TINY words by their first and their last bytes,
   of several lengths around half of the line.
3. Candidates further apart than FAR bits of the whole SimHash fall out, the
   rest is verified by edit similarity (1 - Levenshtein / longer length, of the
   normalised lines) of `similarity` or more. In a bucket of up to SMALL nodes
   all pairs are candidates. In a larger one each node is tried with the
   nearest before it; buckets that the verified links don't join completely are
   then looked at again, and all their pairs across the parts are tried (in
   pairs of chunks of CHUNK nodes, each a group by itself), so no link is lost.
   Such a pair gives a row only if it is a link that joins two parts.
4. Connected groups keep the occurrence that is first by (doc_id, text hash,
   line number); all other occurrences go. Blank lines always stay.

Only narrow rows are shuffled; the text of a line is fetched again for
candidates alone, and documents are rebuilt by joining them with the list of
their dropped lines (broadcast if its stored size is under `broadcast_bytes`,
else by a shuffle).

Given cases: null and empty text stay as they are; documents with lines that
all go are removed, since all they held is kept elsewhere (or kept with a null
text, if asked for); rows that repeat a doc_id with an equal text are one
document and share its outcome; null ids sort first; equal lines tie by
(doc_id, text hash, line number); a very long text is read line by line and a
very long line has as few keys as any other; an empty table gives an empty
one; further columns are carried along, but for those named like the new ones
(dropped_lines, keepers): they are replaced. Hashes of lines have 64 bits:
texts that collide would count as equal.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.batches import relax, sliced, small_batches, unused
from tracemill.llm.components import components, joined
from tracemill.llm.text_hash import mix, simhashes, span_hash, words_of
from tracemill.session import Scratch, path_bytes, stored

BLOCKS, LEAST = 5, 3  # blocks of a line's SimHash, and features that a pair of equal blocks must hold
LONG, FEW, SAMPLE = 5, 6, 12  # bytes of a word that counts, words under which a line has grams, words drawn
GRAM, GRAMS = 4, 8  # bytes of a gram, grams drawn
FAR, SHORT = 17, 11  # bits of the whole SimHash, which is left out of play for lines under SHORT words
BRIEF, TINY = 10, 4  # words of lines that are joined without one or two of them, and by their ends
REST = 0.4  # part of a line that two dropped words may be
ENDS = (2, 3, 4, 6, 8, 12, 16, 24, 32)  # bytes of an end
SMALL, NEAR, CHUNK, BINS = 8, 2048, 8192, 512
SEEN = 1 << 19  # hashes of lines that a task remembers
STRIDE = 16  # characters between looks at the distance so far
BATCH_BYTES = 1 << 19
DIGITS = bytes(ord("0") if chr(b).isdigit() and b < 128 else 32 if b < 32 and b != 10 else b for b in range(256))
MARKS = string.punctuation.encode()
_GRAM = np.array([1 << 8 * i for i in range(GRAM)], np.uint64)


def flattened(text: str) -> bytes:
    """The text in the form whose words are compared; line breaks stay."""
    return text.lower().encode("utf-8", "replace").translate(DIGITS, MARKS)


def normal(line: str) -> str:
    return " ".join(filter(None, flattened(line.replace("\n", " ")).decode().split(" "))) if line else ""


def _block_keys(kind: int, line: np.ndarray, feature: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) for all pairs of blocks with enough different features. line, feature: which feature hashes a line has."""
    cell = line * BLOCKS + (feature % np.uint64(BLOCKS)).astype(np.int64)
    if lines * BLOCKS < 1 << 24:  # both in one number, which is sorted sooner
        order = np.argsort(cell.astype(np.uint64) << np.uint64(40) | feature & np.uint64((1 << 40) - 1))
    else:
        order = np.lexsort((feature, cell))
    cell, feature = cell[order], feature[order]
    fresh = np.ones(len(cell), bool)
    fresh[1:] = (cell[1:] != cell[:-1]) | (feature[1:] != feature[:-1])
    cell, feature = cell[fresh], feature[fresh]
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    last = np.append(first[1:], len(cell))[: len(first)]
    block, held = np.zeros(lines * BLOCKS, np.uint64), np.zeros(lines * BLOCKS, np.int64)
    block[cell[first]], held[cell[first]] = simhashes(feature, first, last), last - first
    block, held = block.reshape(lines, BLOCKS), held.reshape(lines, BLOCKS)
    rows, keys = [], []
    for k, (i, j) in enumerate(combinations(range(BLOCKS), 2)):
        own = np.flatnonzero(held[:, i] + held[:, j] >= LEAST)
        a, b = (block[own, c] + held[own, c].astype(np.uint64) for c in (i, j))
        rows.append(own)
        keys.append(mix(mix(a + np.uint64(k + 16 * kind)) * np.uint64(31) + b))
    return np.concatenate(rows), np.concatenate(keys)


def _without_words(word: np.ndarray, size: np.ndarray, first: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(line, key) of brief lines: their words, and these without one (two at least stay) or two (three stay, and the two are a small part). What stays is hashed in order, so a word may also have been added."""
    for n in range(3, BRIEF + 1):
        own = np.flatnonzero(words == n)
        if not len(own):
            continue
        at = first[own] + np.arange(n)[:, None]
        part, chars = word[at], size[at]
        none, one, two = (np.zeros((k, len(own)), np.uint64) for k in (1, 0, 0))  # hashes so far, with none, one and two words gone
        for k in range(n):
            more = mix(np.concatenate([none, one, two]) * np.uint64(31) + part[k])
            if n > 4:
                two = np.concatenate([more[k + 1 :], one])
            none, one = more[:1], np.concatenate([more[1 : k + 1], none])
        yield np.tile(own, n + 1), mix(np.concatenate([none, one]) + np.uint64(77)).ravel()
        if n > 4:
            i, j = np.array([(i, j) for j in range(n) for i in range(j)]).T
            fits = chars[i] + chars[j] <= REST * chars.sum(axis=0)
            yield own[np.nonzero(fits)[1]], mix(two[fits] + np.uint64(77))


def _by_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(line, key) of tiny lines: their first and last bytes, of each of the lengths in ENDS that is about half of the line."""
    own = np.flatnonzero(words <= TINY)
    if not len(own):
        return
    count = words[own]
    of = np.repeat(np.arange(len(own)), count)
    at = np.repeat(first[own] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    size = ends[at] - starts[at] + 1  # a blank after each word
    chars = data[np.repeat(starts[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))].astype(np.uint64)
    chars[np.cumsum(size) - 1] = 32
    length = np.bincount(of, size, minlength=len(own)).astype(np.int64)
    head = np.cumsum(length) - length
    tail, length = head + length - 1, length - 1
    for n in ENDS:
        some = np.flatnonzero((length * 0.35 <= n) & (n <= length * 0.6))
        yield own[some], mix(span_hash(chars, head[some], head[some] + n) + np.uint64(78))
        yield own[some], mix(span_hash(chars, tail[some] - n, tail[some]) + np.uint64(79))


def _drawn(feature: np.ndarray, of: np.ndarray, most: int) -> np.ndarray:
    """Which features are drawn, about `most` of a line that has `of`."""
    return (feature >> np.uint64(32)).astype(np.float64) * of < most * 2.0**32


def hashed_lines(texts: list[str], seen: set[int] | None = None) -> tuple[np.ndarray, ...]:
    """For all lines with words: text number, line number, line hash, SimHash (its lowest bit tells whether the line is short), and (keys, cuts). seen: hashes of lines that have had their SimHash and keys, which they don't get again; new ones are added."""
    flat = [flattened(t) for t in texts]
    data = np.frombuffer(b"\n".join(flat) + b"\n", np.uint8)
    breaks = data == 10
    starts, ends = words_of(data, breaks | (data == 32))
    if not len(starts):
        none = np.empty(0, np.int64)
        return none, none, none, none, none, np.zeros(1, np.int64)
    line = np.cumsum(breaks)[starts]
    word = span_hash(data.astype(np.uint64), starts, ends)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    last = np.append(first[1:], len(line))
    lines, words, n = line[first], last - first, len(first)
    per_text = np.array([f.count(b"\n") + 1 for f in flat])
    opens = np.concatenate([[0], np.cumsum(per_text)])
    owner = np.searchsorted(opens, lines, side="right") - 1

    lh = span_hash(word, first, last).view(np.int64)
    new = _unseen(lh, seen) if seen is not None else np.arange(n)
    if len(new) < n:
        fresh = np.zeros(n, bool)
        fresh[new] = True
        kept = np.repeat(fresh, words)
        starts, ends, word, words = starts[kept], ends[kept], word[kept], words[new]
        last = np.cumsum(words)
        first = last - words
    keys, of, sims = _keyed(data, starts, ends, word, first, last) if len(new) else (np.zeros(0, np.uint64),) * 3
    sim, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
    sim[new], count[new] = sims.view(np.int64), np.bincount(of.astype(np.int64), minlength=len(new))
    return owner, lines - opens[owner], lh, sim, keys.view(np.int64), np.concatenate([[0], np.cumsum(count)])


def _unseen(lh: np.ndarray, seen: set[int]) -> np.ndarray:
    """The places, in order, at which a hash comes up for the first time."""
    values, at = np.unique(lh, return_index=True)
    values, new = values.tolist(), np.ones(len(values), bool)
    if seen:
        new[:] = [x not in seen for x in values]
    if len(seen) > SEEN:
        seen.clear()
    seen.update(values)
    return np.sort(at[new])


def _keyed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys by line, the line of each, and the SimHash of each line, of the lines with the words first to last."""
    words, n = last - first, len(first)
    at = np.repeat(np.arange(n), words)
    long = ends - starts >= LONG
    many = np.add.reduceat(long.astype(np.int64), first)[at]
    pick = long & (many >= FEW - 1) & _drawn(word, many, SAMPLE)
    found = [_block_keys(0, at[pick], word[pick], n)]
    few = np.flatnonzero(many <= FEW + 1)
    if len(few):  # the normalised lines, a blank after each word
        size = ends[few] - starts[few] + 1
        chars = data[np.repeat(starts[few] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        chars[np.cumsum(size) - 1] = 32
        own = np.repeat(at[few], size)
        grams = np.lib.stride_tricks.sliding_window_view(chars, GRAM) if len(chars) >= GRAM else np.zeros((0, GRAM), np.uint8)
        inside = own[: len(grams)] == own[GRAM - 1 :]
        gram, own = mix(grams[inside].astype(np.uint64) @ _GRAM), own[: len(grams)][inside]
        pick = _drawn(gram, np.bincount(own, minlength=n)[own], GRAMS)
        found.append(_block_keys(1, own[pick], gram[pick], n))
    found += _without_words(word, ends - starts, first, words)
    found += _by_ends(data, starts, ends, first, words)
    row, key = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.sort(row << 32 | np.arange(len(row))) & 0xFFFFFFFF  # stable, and sooner than by places
    sim = simhashes(word, first, last) & ~np.uint64(1) | (words < SHORT).astype(np.uint64)
    return key[order], row[order], sim


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BATCH_BYTES):
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a partition; of equal ones mostly the first alone has keys."""
    seen: set[int] = set()
    for b in sliced(batches):
        texts = b.column(2).to_pylist()
        for lo, hi in _pieces(texts):
            owner, pos, lh, sim, keys, cuts = hashed_lines(texts[lo:hi], seen)
            at = pa.array(owner + lo)
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(keys, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(pos, pa.int32()), pa.array(lh, pa.int64()), pa.array(sim, pa.int64()), lists], names=["doc_id", "th", "pos", "lh", "sim", "keys"])


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which SimHashes differ; 0 where one of them is a short line's."""
    return np.where((a | b) & np.uint64(1), 0, np.bitwise_count(a ^ b))


def nearest(sims: np.ndarray) -> np.ndarray:
    """For each but the first the place of the one before it with the fewest differing bits."""
    out = np.zeros(len(sims), np.int64)
    for lo in range(0, len(sims), 256):
        part = np.bitwise_count(sims[lo : lo + 256, None] ^ sims[None, : lo + 256])
        part[np.arange(part.shape[1])[None, :] >= lo + np.arange(len(part))[:, None]] = 255
        out[lo : lo + 256] = part.argmin(axis=1)
    return out[1:]


def _large(lh: np.ndarray, sim: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a large bucket that mostly join what belongs together: each member and the nearest before it in its chunk, and the eight nearest of each chunk and the first one's head."""
    for at in range(0, len(lh), NEAR):
        own, there = lh[at : at + NEAR], sim[at : at + NEAR]
        j = nearest(there)
        ok = apart(there[1:], there[j]) <= FAR
        yield own[1:][ok], own[j[ok]]
        if at:
            gap = np.bitwise_count(there[:256, None] ^ sim[None, :256])
            a, b = np.unravel_index(np.argsort(gap, axis=None, kind="stable")[:8], gap.shape)
            yield own[a], lh[b]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of (k, lh, sim), whole buckets, with repeats -> (a, b, null), pairs to verify, and (lh, sim, k), the members of buckets that are not small. 24 bytes a row are held."""
    held = [[c.to_numpy() for c in b.columns] for b in batches]
    if not held:
        return
    k, lh, sim = (np.concatenate(x) for x in zip(*held, strict=True))
    del held
    if not len(k):
        return
    order = np.argsort(k)
    k = k[order]
    shared = np.zeros(len(k) + 1, bool)
    shared[1:-1] = k[1:] == k[:-1]
    shared = shared[1:] | shared[:-1]  # most keys are of one line
    if not shared.any():
        return
    k, lh, sim = k[shared], lh[order[shared]], sim[order[shared]]
    order = np.lexsort((lh, k))
    k, lh, sim = k[order], lh[order], sim[order].view(np.uint64)
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (lh[1:] != lh[:-1])
    k, lh, sim = k[fresh], lh[fresh], sim[fresh]
    cuts = np.append(np.flatnonzero(np.diff(k, prepend=~k[0])), len(k))
    size = np.repeat(np.diff(cuts), np.diff(cuts))
    pairs = []
    for step in range(1, SMALL):
        i = np.flatnonzero((k[step:] == k[:-step]) & (size[step:] <= SMALL))
        i = i[apart(sim[i], sim[i + step]) <= FAR]
        pairs.append((lh[i], lh[i + step]))
    large = np.flatnonzero(np.diff(cuts) > SMALL)
    for lo, hi in zip(cuts[large], cuts[large + 1], strict=True):
        pairs += _large(lh[lo:hi], sim[lo:hi])
    found = np.unique(np.stack([np.concatenate(x) for x in zip(*((np.minimum(a, b), np.maximum(a, b)) for a, b in pairs), strict=True)], axis=1), axis=0)
    if len(found):
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.nulls(len(found), pa.int64())], names=["a", "b", "k"])
    many = size > SMALL
    if many.any():
        yield pa.RecordBatch.from_arrays([pa.array(lh[many]), pa.array(sim[many].view(np.int64)), pa.array(k[many])], names=["a", "b", "k"])
    relax()


def bigrams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring characters of each line, counted in BINS bins by hash, and the characters of each; no counts for a line too long for them."""
    counts, size = np.zeros((len(lines), BINS), np.uint16), np.array([len(x) for x in lines])
    for row, line in zip(counts, lines, strict=True):
        if 2 <= len(line) < 1 << 16:
            c = np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32)
            row[:] = np.bincount((c[:-1] * np.uint32(31) + c[1:]) % BINS, minlength=BINS)
    return counts, size


def reachable(counts: np.ndarray, size: np.ndarray, x: int, near: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the lines in `near` can be similar enough to line x: one edit takes two pairs of characters from a line at most, so half of those that the other lacks bounds the distance from below. Bins that hold several pairs only lower the bound."""
    both = np.minimum(counts[x], counts[near]).sum(axis=1, dtype=np.int64)
    longer = np.maximum(size[near], size[x])
    lacking = np.where(longer < 1 << 16, longer - 1 - both, 0)
    return (lacking + 1) // 2 <= np.floor(longer * (1 - similarity) + 1e-9)


def _across(similarity: float) -> callable:
    """The rows (k, i, j, chunk, lh, sim, part, line) of one bucket and one pair of its chunks -> links that join parts. Every pair across parts that is near enough is verified, unless its parts have been joined meanwhile."""

    def run(rows: pa.Table) -> pa.Table:
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        lh, chunk, part = rows["lh"].to_numpy(), rows["chunk"].to_numpy(), rows["part"].to_numpy().copy()
        sim, line = rows["sim"].to_numpy().view(np.uint64), rows["line"].to_pylist()
        ones = np.flatnonzero(chunk == i)
        others = ones if i == j else np.flatnonzero(chunk == j)
        words, (counts, size) = [x.split(" ") for x in line], bigrams(line)
        out = []
        for x in ones.tolist():
            near = others[(part[others] != part[x]) & ((lh[others] > lh[x]) if i == j else True)]
            near = near[apart(sim[[x]], sim[near]) <= FAR]
            if not len(near):
                continue
            for y in near[reachable(counts, size, x, near, similarity)].tolist():
                p, q = part[x], part[y]
                if p != q and alike(line[x], line[y], similarity, words[x], words[y], True):
                    part[part == max(p, q)] = min(p, q)
                    out.append((min(lh[x], lh[y]), max(lh[x], lh[y])))
        a, b = zip(*out, strict=True) if out else ((), ())
        if len(lh) > 256:
            relax()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def across(members: DataFrame, parts: DataFrame, texts: DataFrame, similarity: float, broadcast_bytes: int, keep: Scratch) -> DataFrame:
    """members(k, lh, sim) of large buckets; parts(node, comp), what is joined so far; texts(lh, line) -> (a, b), the links that were still missing."""
    named = members.join(parts, members["lh"] == parts["node"], "left").select("k", "lh", "sim", F.coalesce("comp", "lh").alias("part"))
    torn = named.groupBy("k").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("c")).where("lo <> hi")
    torn = keep(torn.select("k", F.ceil(F.col("c") / CHUNK).cast("int").alias("q")), "line-torn")
    held = F.broadcast(torn) if path_bytes(parts.sparkSession, torn._stored_at) <= broadcast_bytes else torn
    dealt = named.join(held, "k").withColumn("chunk", F.pmod(F.xxhash64("lh"), F.col("q")).cast("int"))
    dealt = dealt.join(texts, "lh").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    dealt = dealt.select("k", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "lh", "sim", "part", "line")
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work: not to be put together
    return dealt.repartition(n, "k", "i", "j").groupBy("k", "i", "j").applyInArrow(_across(similarity), "a long, b long")


def _rebuild(names: list[str], at: int, keep_emptied: bool) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            gone, out, dropped, keepers = b.column(len(names)).to_pylist(), [], [], []
            some = np.array([bool(g) for g in gone])
            for t, g in zip(b.column(at).filter(pa.array(some)).to_pylist(), filter(None, gone), strict=True):
                go = {x["pos"] for x in g}
                left = [x for i, x in enumerate(t.split("\n")) if i not in go]
                out.append("\n".join(left) if any(normal(x) for x in left) else None)
            for g in gone:
                dropped.append(len(g) if g else 0)
                keepers.append(sorted({x["doc_id"] for x in g if x["doc_id"] is not None}) if g else [])
            emptied = np.zeros(len(b), bool)
            emptied[np.flatnonzero(some)] = [x is None for x in out]
            text = pc.replace_with_mask(b.column(at), pa.array(some), pa.array(out, b.column(at).type))
            cols = [text if i == at else b.column(i) for i in range(len(names))]
            made = pa.RecordBatch.from_arrays([*cols, pa.array(dropped, pa.int32()), pa.array(keepers, pa.list_(pa.int64()))], names=[*names, "dropped_lines", "keepers"])
            yield made if keep_emptied else made.filter(pa.array(~emptied))

    return run


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def dropped_lines(docs: DataFrame, similarity: float = 0.8, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, th, gone): for each document with dropped lines, these lines' numbers from 0, each with the doc_id and line that is kept instead."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    with Scratch() as keep:
        lines = keep(rows.mapInArrow(_lines, "doc_id long, th long, pos int, lh long, sim long, keys array<long>"), "lines")
        where = F.struct("doc_id", "th", "pos")
        nodes = keep(lines.groupBy("lh").agg(F.min(where).alias("first"), F.count("*").alias("n")), "line-nodes")

        keyed = lines.select(F.explode("keys").alias("k"), "lh", "sim")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() * 10 // 2_000_000))
        found = keep(keyed.repartition(parts, "k").mapInArrow(_candidates, "a long, b long, k long"), "line-candidates")
        pairs = found.where("k is null").select("a", "b").distinct()
        members = found.where("k is not null").select("k", F.col("a").alias("lh"), F.col("b").alias("sim"))

        # the text of the lines that take part in a candidate pair, from one occurrence of each
        wanted = found.select(F.col("a").alias("lh")).union(found.where("k is null").select("b")).distinct()
        taken = keep(nodes.select("lh", "first").join(wanted, "lh").select("lh", "first.doc_id", "first.th", "first.pos"), "line-wanted")
        asked = taken.groupBy(F.col("doc_id").alias("d"), "th").agg(F.collect_list(F.struct("pos", "lh")).alias("asked"))
        asked = F.broadcast(asked) if path_bytes(spark, taken._stored_at) <= broadcast_bytes else asked
        texts = rows.join(asked, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["th"] == asked["th"])).select("text", "asked")
        texts = keep(texts.mapInArrow(_fetch, "lh long, line string").dropDuplicates(["lh"]), "line-texts")
        left, right = texts.toDF("a", "la"), texts.toDF("b", "lb")

        links = keep(pairs.join(left, "a").join(right, "b").select("a", "b", "la", "lb").mapInArrow(_verified(similarity), "a long, b long"), "line-links")
        first_groups = components(links)
        keep.held.append(first_groups)
        missing = across(members, first_groups, texts, similarity, broadcast_bytes, keep)
        more = keep(missing, "line-links")
        groups = joined(first_groups, more, keep).toDF("lh", "comp")
        there = nodes.select("lh", "first").join(groups, "lh").select("lh", "comp", "first")
        firsts = there.groupBy("comp").agg(F.min("first").alias("keeper"))
        fuzzy_keep = there.join(firsts, "comp").select("lh", "keeper")
        repeated = nodes.where("n > 1").select("lh", F.col("first").alias("own"))
        kept = keep(repeated.join(fuzzy_keep, "lh", "full_outer").select("lh", F.coalesce("keeper", "own").alias("keeper")), "line-keepers")
        held = F.broadcast(kept) if path_bytes(spark, kept._stored_at) <= broadcast_bytes else kept
        gone = lines.select("doc_id", "th", "pos", "lh").join(held, "lh").where(~where.eqNullSafe(F.col("keeper")))
        return stored(gone.groupBy("doc_id", "th").agg(F.collect_set(F.struct(F.col("pos"), F.col("keeper.doc_id").alias("doc_id"), F.col("keeper.pos").alias("line"))).alias("gone")), "dropped-lines")


def edits(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or some number over `most` if it is larger. One bit per character of a (Myers), one step per character of b; looked at every STRIDE steps."""
    if not a or not b:
        return len(a) + len(b)
    bits: dict[str, int] = {}
    for i, c in enumerate(a):
        bits[c] = bits.get(c, 0) | 1 << i
    full, up, down, at = (1 << len(a)) - 1, (1 << len(a)) - 1, 0, len(a)
    for lo in range(0, len(b), STRIDE):
        for c in b[lo : lo + STRIDE]:
            same = bits.get(c, 0)
            cross = same | down
            level = (((same & up) + up) ^ up) | same
            rise = ((level | up) ^ full | down) << 1 | 1
            up = ((level & up) << 1 | (cross | rise) ^ full) & full
            down = rise & cross
        done = min(lo + STRIDE, len(b))
        at = done + up.bit_count() - down.bit_count()
        if at - (len(b) - done) > most:
            return at - (len(b) - done)
    return at


def unlike(a: str, b: str, most: int) -> bool:
    """Whether more than `most` edits lie between a and b by their characters, or pairs of neighbouring ones: one edit takes one, or two pairs, from a line at most."""
    longer = max(len(a), len(b))
    if longer - (Counter(a) & Counter(b)).total() > most:
        return True
    x, y = Counter(zip(a, a[1:], strict=False)), Counter(zip(b, b[1:], strict=False))
    return longer - 1 - (x & y).total() > 2 * most


def replaced(x: list[str], y: list[str], most: int) -> bool:
    """Whether replacing, dropping or adding whole words leads from x to y within `most` edits, going by the next words that are equal: an upper bound of the distance."""
    i = j = cost = 0
    while i < len(x) and j < len(y):
        p, q = x[i], y[j]
        if p != q:
            if i + 1 < len(x) and x[i + 1] == q and not (j + 1 < len(y) and x[i + 1] == y[j + 1]):
                cost += len(p) + 1
                j -= 1
            elif j + 1 < len(y) and p == y[j + 1] and not (i + 1 < len(x) and x[i + 1] == y[j + 1]):
                cost += len(q) + 1
                i -= 1
            else:
                cost += max(len(p), len(q))
            if cost > most:
                return False
        i += 1
        j += 1
    return cost + sum(len(p) + 1 for p in (*x[i:], *y[j:])) <= most


def alike(a: str, b: str, similarity: float, x: list[str] | None = None, y: list[str] | None = None, bounded: bool = False) -> bool:
    """Whether 1 - edits / longer length reaches similarity. Equal ends cost nothing; going word by word, or replacing all between the equal ends, bounds the distance from above and mostly decides. x and y: their words, if they are known; bounded: their pairs of characters have been compared."""
    most = int(max(len(a), len(b)) * (1 - similarity) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    if replaced(x or a.split(" "), y or b.split(" "), most):
        return True
    lo = len(commonprefix((a, b)))
    a, b = a[lo:], b[lo:]
    end = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - end], b[: len(b) - end]
    return max(len(a), len(b)) <= most or (bounded or not unlike(a, b, most)) and edits(a, b, most) <= most


def _verified(similarity: float) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield b.filter(pa.array([alike(x, y, similarity) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())).select(["a", "b"])

    return run


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        rows = []
        for text, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            lines = text.split("\n")
            rows += [(a["lh"], normal(lines[a["pos"]])) for a in asked]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["lh", "line"])


def dedup(docs: DataFrame, keep_emptied: bool = False, broadcast_bytes: int = 32 << 20, **params) -> DataFrame:
    """docs with the lines that stay, dropped_lines, the number of those that went, and keepers, the ids of the documents that hold them instead. keep_emptied: documents without a line left stay, with a null text."""
    found = dropped_lines(docs, broadcast_bytes=broadcast_bytes, **params)
    docs = docs.drop("dropped_lines", "keepers")
    doc, hashed, list_ = unused(docs, "__doc", "__th", "__gone")
    gone = found.toDF(doc, hashed, list_)
    gone = F.broadcast(gone) if path_bytes(docs.sparkSession, found._stored_at) <= broadcast_bytes else gone
    on = docs["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (_text_hash(docs["text"].cast("string")) == F.col(hashed))
    names = docs.columns
    rows = docs.join(gone, on, "left").select(*[docs[c] for c in names], list_)
    schema = T.StructType([*docs.schema.fields, T.StructField("dropped_lines", T.IntegerType()), T.StructField("keepers", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(_rebuild(names, names.index("text"), keep_emptied), schema)
