"""SimHash near-dedup by the similarity of word shingles (Jaccard, 0.8 by default).

A SimHash of 64 bits whose every bit hears every shingle can't serve here: at
similarity 0.8 two of them differ in some ten bits, for which no key of enough
bits stays equal. So the fingerprint is wider and its segments hear different
shingles:

1. A document is the set of hashes of its shingles of `width` words (lower
   case, divided at blanks; a character of a script without blanks is a word
   by itself). Documents with equal sets are one class.
2. SAMPLE shingles of a set (all of a smaller one), drawn by hash, are dealt to
   SEGMENTS segments by hash, and each segment is the SimHash of its own. A
   segment of equal shingles is equal, so two sets of similarity s agree in a
   segment with a chance of exp(-SAMPLE / SEGMENTS * 2 * (1 - s) / (1 + s)):
   0.41 at 0.8, and in two or more of 16 with a chance of 0.997.
3. Pigeonring: if BUDGET segments differ at most, there is a segment from which
   on, for every l, at most floor(l * BUDGET / SEGMENTS) of the next l differ.
   For l = 1 that is none: classes are joined under each equal segment. The
   longer chains are then checked, and what fails is no candidate.
4. Under one key each class is first compared with one pivot, so a large group
   costs no more pairs than it has members; then, within the keys whose classes
   the links don't join completely, all pairs across the parts. A key of more
   than CHUNK classes is divided by a second equal segment first, which every
   candidate has (sets of up to TINY shingles, which leave segments empty, by
   their size instead): what merely shares one segment, as a licence or a
   template page does, falls apart into groups of its own.
5. Every candidate is verified by the exact similarity of its sets of hashes.

Given cases: null and wordless texts have the empty set and are one class; a
text under `width` words is one shingle; a very long text has a set of all its
shingles, held by one task; ties (equal sets) and repeated rows are one class;
null ids are kept and never the first; an empty table gives an empty one; all
columns are carried along, whatever their names. Sets have hashes of 64 bits:
shingles that collide would count as equal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.batches import sliced, small_batches, unused
from tracemill.llm.components import components, joined
from tracemill.llm.text_hash import mix, simhashes, span_hash, words_of
from tracemill.session import Scratch, discard, path_bytes, stored

WIDTH, SIMILARITY = 5, 0.8
SEGMENTS, SAMPLE, BUDGET = 16, 64, 14
CHUNK = 512  # classes of one key that are compared with one another in one group
TINY = 40  # shingles of a set that may share one segment only, others being empty
BATCH_BYTES = 256 << 10
UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿]")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_CHAIN = np.arange(1, SEGMENTS + 1) * BUDGET // SEGMENTS


def shingles(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, cuts): the distinct, sorted shingle hashes of text i are hashes[cuts[i]:cuts[i + 1]]."""
    data = [UNSPACED.sub(r" \g<0> ", (t or "").lower()).encode("utf-8", "replace") for t in texts]
    a = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    starts, ends = words_of(a, _BLANK[a])
    word = span_hash(a.astype(np.uint64), starts, ends)
    owner = np.searchsorted(np.cumsum([len(d) + 1 for d in data]), starts, side="right")
    words = np.bincount(owner, minlength=len(texts))
    last = np.cumsum(words)[owner]
    at = np.arange(len(owner))
    heads = np.flatnonzero((at + width <= last) | (at == last - words[owner]))
    h = span_hash(word, heads, np.minimum(heads + width, last[heads]))
    owner = owner[heads]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[fresh], np.searchsorted(owner[fresh], np.arange(len(texts) + 1))


def segments(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The SEGMENTS segments of each set, mixed with their number; 0 where no shingle was drawn."""
    size = np.diff(cuts)
    owner = np.repeat(np.arange(len(size)), size)
    drawn = np.flatnonzero((h >> np.uint64(32)).astype(np.float64) * size[owner] < SAMPLE * 2.0**32)
    h, owner = h[drawn], owner[drawn]
    cell = owner * SEGMENTS + (h % np.uint64(SEGMENTS)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell, h = cell[order], h[order]
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    last = np.append(first[1:], len(cell))[: len(first)]
    out = np.zeros(len(size) * SEGMENTS, np.uint64)
    made = mix(simhashes(h, first, last) + (cell[first] % SEGMENTS + SEGMENTS * (last - first)).astype(np.uint64))
    out[cell[first]] = np.where(made == 0, 1, made)
    return out.reshape(-1, SEGMENTS)


def chained(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of segments: whether some chain around the whole ring keeps its budget at every length."""
    differ = (a != b).astype(np.int16)
    sums = np.cumsum(np.concatenate([np.zeros((len(differ), 1), np.int16), differ, differ], axis=1), axis=1)
    out = np.zeros(len(differ), bool)
    for start in range(SEGMENTS):
        out |= (sums[:, start + 1 : start + SEGMENTS + 1] - sums[:, [start]] <= _CHAIN).all(axis=1)
    return out


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= BATCH_BYTES):
            size += len(texts[hi] or "")
            hi += 1
        yield lo, hi
        lo = hi


def _hashed(width: int) -> callable:
    """(doc_id, th, text) -> (doc_id, th, sh, n, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = b.column(2).to_pylist()
            for lo, hi in _pieces(texts):
                h, cuts = shingles(texts[lo:hi], width)
                n = np.diff(cuts)
                some = n > 0
                sh = np.zeros(hi - lo, np.uint64)
                sh[some] = span_hash(h, cuts[:-1][some], cuts[1:][some])
                keys = segments(h, cuts)
                ends = np.concatenate([[0], np.cumsum((keys != 0).sum(axis=1))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[keys != 0].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(sh.view(np.int64)), pa.array(n, pa.int32()), lists], names=["doc_id", "th", "sh", "n", "keys"])

    return run


def _sets(width: int) -> callable:
    """(sh, text) -> (sh, grams, keys); texts have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = b.column(1).to_pylist()
            for lo, hi in _pieces(texts):
                h, cuts = shingles(texts[lo:hi], width)
                keys = segments(h, cuts)
                lists = [pa.ListArray.from_arrays(pa.array(c, pa.int32()), pa.array(x.ravel().view(np.int64))) for c, x in ((cuts, h), (np.arange(len(keys) + 1) * SEGMENTS, keys))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *lists], names=["sh", "grams", "keys"])

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _verified(similarity: float) -> callable:
    """(a, b, ga, gb, ka, kb) -> (a, b) of those that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 64):
            ka, kb = (c.flatten().to_numpy().reshape(-1, SEGMENTS) for c in (b.column(4), b.column(5)))
            ok = [chain and jaccard(x.values.to_numpy(), y.values.to_numpy()) >= similarity - 1e-9 for chain, x, y in zip(chained(ka, kb).tolist(), b.column(2), b.column(3), strict=True)]
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return run


def _crossing(similarity: float) -> callable:
    """The rows of one key, one second key (0: none) and one pair of chunks -> all similar pairs across chunks (or within the one chunk) and parts whose first common keys these are."""

    def run(rows: pa.Table) -> pa.Table:
        grams = [x.values.to_numpy() for x in rows["grams"].combine_chunks()]
        keys = np.stack([x.values.to_numpy() for x in rows["keys"].combine_chunks()])
        k, k2, i, j = (rows[c][0].as_py() for c in ("k", "k2", "i", "j"))
        sh, part, chunk = (rows[c].to_numpy() for c in ("sh", "part", "chunk"))
        n = np.array([len(g) for g in grams])
        ones = np.flatnonzero(chunk == i)
        others = ones if i == j else np.flatnonzero(chunk == j)
        out = []
        for x in ones:
            y = others[part[others] != part[x]]
            y = y[y > x] if i == j else y
            y = y[np.minimum(n[y], n[x]) >= np.maximum(n[y], n[x]) * similarity - 1e-9]
            if len(y):
                common = (keys[y] == keys[x]) & (keys[x] != 0)
                at = common.argmax(axis=1)
                ok = keys[x][at] == k
                if k2:
                    common[np.arange(len(y)), at] = False
                    ok &= np.where(common.any(axis=1), keys[x][common.argmax(axis=1)], -np.maximum(n[y], n[x])) == k2
                y = y[ok]
                y = y[chained(keys[y], keys[[x]])]
            out += [(min(sh[x], sh[z]), max(sh[x], sh[z])) for z in y if jaccard(grams[x], grams[z]) >= similarity - 1e-9]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def dealt(parts: DataFrame, keys: DataFrame, similarity: float, keep: Scratch) -> DataFrame:
    """parts(k, sh, n, part), the classes of every key with what they are joined to so far, and keys(sh, keys) -> (k, k2, i, j, chunk, sh, part): in which groups a class meets those of other parts."""
    spread = [F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("c")]
    torn = keep(parts.groupBy("k").agg(*spread).where("lo <> hi").select("k", "c"), "shingle-torn")
    few = parts.join(torn.where(F.col("c") <= CHUNK), "k").select("k", F.lit(0).cast("long").alias("k2"), "sh", "part", F.lit(1).alias("q"))
    # a large key by the other segments of its classes, or, for tiny sets, by the sizes that theirs is similar to
    sizes = F.when(F.col("n") <= TINY, F.transform(F.sequence("n", F.floor(F.col("n") / F.lit(similarity) + F.lit(1e-9)).cast("int")), lambda x: -x.cast("long"))).otherwise(F.array().cast("array<long>"))
    second = F.array_distinct(F.concat(F.filter("keys", lambda x: (x != 0) & (x != F.col("k"))), sizes))
    many = parts.join(torn.where(F.col("c") > CHUNK).select("k"), "k").join(keys, "sh").select("k", F.explode(second).alias("k2"), "sh", "part")
    many = keep(many, "shingle-seconds")
    left = many.groupBy("k", "k2").agg(*spread).where("lo <> hi").select("k", "k2", F.ceil(F.col("c") / CHUNK).cast("int").alias("q"))
    both = few.unionByName(many.join(left, ["k", "k2"]))
    # what is still large is divided into chunks, and each pair of chunks is a group by itself
    chunked = both.withColumn("chunk", F.pmod(F.xxhash64("sh"), F.col("q")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    return chunked.select("k", "k2", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "sh", "part")


def groups(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, broadcast_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """(each, comps), stored tables: (doc_id, th, sh, ...) for every row of docs(doc_id, text), and (sh, comp) for the sets that are linked to others."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    each = stored(rows.mapInArrow(_hashed(width), "doc_id long, th long, sh long, n int, keys array<long>"), "shingles")
    with Scratch() as keep:
        keyed = keep(each.select(F.explode("keys").alias("k"), "sh", "n").distinct(), "shingle-keys")
        shared = keyed.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
        members = keep(keyed.join(shared, "k"), "shingle-members")

        # the sets of the classes with a common key, from one document of each
        firsts = each.join(members.select("sh").distinct(), "sh").groupBy("sh").agg(F.min(F.struct("doc_id", "th")).alias("f"))
        firsts = keep(firsts.select("sh", F.col("f.doc_id").alias("d"), F.col("f.th").alias("t")), "shingle-firsts")
        asked = F.broadcast(firsts) if path_bytes(docs.sparkSession, firsts._stored_at) <= broadcast_bytes else firsts
        texts = rows.join(asked, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["th"] == F.col("t"))).select("sh", "text")
        sets = keep(texts.mapInArrow(_sets(width), "sh long, grams array<long>, keys array<long>").dropDuplicates(["sh"]), "shingle-sets")
        left, right = sets.toDF("a", "ga", "ka"), sets.toDF("b", "gb", "kb")
        fits = F.least("n", "n2") >= F.greatest("n", "n2") * F.lit(similarity) - F.lit(1e-9)

        pivots = members.groupBy("k").agg(F.min(F.struct("sh", "n")).alias("p")).select("k", F.col("p.sh").alias("sh2"), F.col("p.n").alias("n2"))
        pairs = members.join(pivots, "k").where("sh <> sh2").where(fits).select(F.least("sh", "sh2").alias("a"), F.greatest("sh", "sh2").alias("b")).distinct()
        links = keep(pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "gb", "ka", "kb").mapInArrow(_verified(similarity), "a long, b long"), "shingle-links")
        first = components(links)
        keep.held.append(first)
        comps = first.toDF("sh", "comp")
        parts = members.join(comps, "sh", "left").select("k", "sh", "n", F.coalesce("comp", "sh").alias("part"))
        meet = dealt(parts, sets.select("sh", "keys"), similarity, keep).join(sets, "sh")
        more = keep(meet.groupBy("k", "k2", "i", "j").applyInArrow(_crossing(similarity), "a long, b long"), "shingle-links")
        return each, stored(joined(first, more, keep).toDF("sh", "comp"), "shingle-groups")


def keep_first(docs: DataFrame, **params) -> DataFrame:
    """docs with one row of each group: the smallest (doc_id, text hash), null ids last, and of rows that repeat it the one whose columns come first as JSON (columns of any type, maps too)."""
    each, comps = groups(docs.select("doc_id", "text"), **params)
    rows = each.groupBy("sh", "doc_id", "th").agg(F.count("*").alias("c"))
    classes = rows.groupBy("sh").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "c")).alias("first"))
    lowest = classes.join(comps, "sh", "left").groupBy(F.coalesce("comp", "sh").alias("comp")).agg(F.min("first").alias("first"))
    doc, hashed, times, row = unused(docs, "__doc", "__th", "__c", "__row")
    stays = stored(lowest.select(F.col("first.doc_id").alias(doc), F.col("first.th").alias(hashed), F.col("first.c").alias(times)), "shingle-stays")
    on = docs["doc_id"].cast("long").eqNullSafe(F.col(doc)) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(F.col(hashed))
    discard(each)
    discard(comps)
    many = stays.where(F.col(times) > 1)
    if many.isEmpty():
        return docs.join(stays, on, "left_semi")
    whole = F.struct(*[docs[c] for c in docs.columns])
    repeated = docs.join(many, on).groupBy(doc, hashed).agg(F.min_by(whole, F.to_json(whole, {"ignoreNullFields": "false"})).alias(row))
    return docs.join(stays.where(F.col(times) == 1), on, "left_semi").union(repeated.select(f"{row}.*"))
