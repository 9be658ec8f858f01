"""Benchmark decontamination on canonical templates.

Benchmark items and documents are read as tokens; numbers, units that follow a
number, and names (capitalised words inside a sentence) become typed
placeholders, everything else its lower-case form. Windows of eight tokens (a
shorter item is one window) with enough literal tokens are hashed and looked up
in the index of all items' windows. A second form keeps names as literals, so
that copies in another case are found as well. A third takes every token as it
is, however few are literals, so that plain copies of texts dense in figures
are found. All this is done again with every name of several words as one
placeholder, so that a longer name may stand for a shorter one.

A hit gives a diagonal (document position minus item position). Tokens on it
agree if they are equal, both numbers, both units, or both capitalised. Runs of
agreeing tokens that hold a hit are joined as long as the slots agree: one item
value must stand for one document value throughout and the other way round.
Values are compared as words, whatever type they were read as; at a conflict
the run goes on from just after the earlier of the two slots. A document is
reported for an item if a consistent run covers `cover` tokens (or the whole of
a shorter item). `changed` counts the slots whose values differ: zero is a
plain copy, more a re-parameterised one, whose run must hold three different
words that are literals in both (two, if the item has no more), since figures
in a row fit any others. Items of three and four tokens would be found inside
ordinary sentences: their template must fill a sentence (a label as in "Q:" may
stand before it), unless it has a number among two literals. Items of one and
two tokens are looked for as whole lines, word for word.

The index is built in slabs of `slab_bytes` of item text at most; each slab is
broadcast and all documents are scanned against it, so memory is bounded
whatever the benchmark's size.

Given cases: null, empty and wordless texts match nothing; a very long text is
scanned whole, by itself; repeated documents give repeated rows; repeated items
one row for each item_id; of runs of equal length the one with fewer changed
slots counts; null ids are reported as null; with an empty benchmark or no
documents the result is empty. contaminated() ignores other columns; clean()
carries all columns along, and goes by the text alone, so repeated and null ids
don't matter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.batches import sliced, small_batches
from tracemill.llm.text_hash import span_hash, words_of

WINDOW, SHORT, SHORTEST = 8, 5, 3  # under SHORT tokens an item must fill a sentence, under SHORTEST a line
LITERALS, WORDS = 2, 3  # literal tokens of a window, and different ones of a run that isn't a plain copy
BATCH_BYTES = 256 << 10
LITERAL, NUMBER, UNIT, NAME = range(4)
MARK = np.array([0, 0xA5A5, 0xB6B6, 0xC7C7], np.uint64)  # what stands for a placeholder of each type

#: Unit words, in lower case.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l s ms min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds liter liters litre litres "
    "dollar dollars euro euros cent cents usd eur gbp percent degrees mph kmh w kw mw v a hz khz mhz ghz kb mb gb tb bytes bits"
).split()

#: Written numbers, in lower case, but for those that are articles or other common words.
WRITTEN = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "deux trois quatre cinq sept huit dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille "
    "dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil"
).split()

_BREAK = np.zeros(256, bool)
_BREAK[: 33] = True
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _BREAK[_c] = True
_STOP, _LABEL = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".!?\n")] = True
_LABEL[list(b':)]>*|"')] = True  # what stands between a label, or an opening, and a question
#: Of characters of two and three bytes, by code point: the small letter of a capital (0: none, or none of as many bytes).
_SMALL = np.zeros(1 << 16, np.uint16)
for _i in [*range(0x80, 0xD800), *range(0xE000, 1 << 16)]:
    if chr(_i).isupper() and len(chr(_i).lower()) == 1 and (0x80 <= ord(chr(_i).lower()) < 0x800) == (_i < 0x800) and 0x80 <= ord(chr(_i).lower()) < 1 << 16:
        _SMALL[_i] = ord(chr(_i).lower())


def lowered(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes with capitals as small letters, and whether a capital begins at a byte."""
    low, capital = a.copy(), (a >= 65) & (a <= 90)
    low[capital] += 32
    for lead, last, size in ((0xC2, 0xDF, 2), (0xE0, 0xEF, 3)):
        at = np.flatnonzero((a[: len(a) - size + 1] >= lead) & (a[: len(a) - size + 1] <= last))
        if not len(at):
            continue
        code = a[at].astype(np.int64) & (0x1F if size == 2 else 0x0F)
        for k in range(1, size):
            code = code << 6 | (a[at + k] & 0x3F)
        small = _SMALL[code].astype(np.int64)
        at, small = at[small > 0], small[small > 0]
        capital[at] = True
        for k in range(size - 1, 0, -1):
            low[at + k] = 0x80 | (small & 0x3F)
            small >>= 6
        low[at] = (0xC0 if size == 2 else 0xE0) | small
    return low, capital


@dataclass
class Tokens:
    typed: np.ndarray  # hash with placeholders
    plain: np.ndarray  # hash with names as literals
    kind: np.ndarray
    surface: np.ndarray  # hash of the lower-case word
    capital: np.ndarray
    owner: np.ndarray
    opens: np.ndarray  # first of its line
    closes: np.ndarray  # last of its line
    begins: np.ndarray  # first of its sentence, or after a label
    finishes: np.ndarray  # last of its sentence


_unit_hashes: np.ndarray | None = None
_written_hashes: np.ndarray | None = None


def _word_hashes(text: str) -> np.ndarray:
    a = np.frombuffer(text.encode(), np.uint8)
    s, e = words_of(a, _BREAK[a])
    return span_hash(a.astype(np.uint64), s, e)


def tokens(texts: list[str]) -> tuple[Tokens, Tokens]:
    """The tokens of all texts, in order, by words and with each name of several words as one; owner is the text's place in the list."""
    global _unit_hashes, _written_hashes
    if _unit_hashes is None or _written_hashes is None:
        _unit_hashes, _written_hashes = (np.unique(_word_hashes(" ".join(x))) for x in (UNITS, WRITTEN))
    data = [t.encode("utf-8", "replace") for t in texts]
    a = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    starts, ends = words_of(a, _BREAK[a])
    low, upper = lowered(a)
    first = a[starts]
    capital = upper[starts]
    number = (first >= 48) & (first <= 57)

    gap = np.diff(starts, prepend=0) - np.concatenate([[0], (ends - starts)[:-1]]) if len(starts) else starts
    before = a[np.maximum(starts - 1, 0)]
    tail = np.zeros(len(starts), bool)
    tail[1:] = number[1:] & number[:-1] & (gap[1:] == 1) & ((before[1:] == 46) | (before[1:] == 44))
    stops, labels = (np.concatenate([[0], np.cumsum(x[a])]) for x in (_STOP, _STOP | _LABEL))
    opens, begins = np.ones(len(starts), bool), np.ones(len(starts), bool)
    opens[1:] = stops[starts[1:]] > stops[ends[:-1]]
    begins[1:] = labels[starts[1:]] > labels[ends[:-1]]

    at = np.arange(len(starts))
    labelled = begins & (at - np.maximum.accumulate(np.where(opens, at, 0)) <= 2)  # after a label of one or two words a sentence begins
    keep = ~tail
    group = np.flatnonzero(keep)
    ends = ends[np.append(group[1:] - 1, len(ends) - 1)] if len(group) else ends[:0]
    starts, capital, number, begins, labelled = (x[keep] for x in (starts, capital, number, begins, labelled))
    surface = span_hash(low.astype(np.uint64), starts, ends)
    of = lambda known: known[np.minimum(np.searchsorted(known, surface), len(known) - 1)] == surface
    number = number | of(_written_hashes)
    unit = np.zeros(len(starts), bool)
    unit[1:] = number[:-1] & of(_unit_hashes)[1:] & ~number[1:]
    kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(capital & ~labelled, NAME, LITERAL)))
    typed = np.where(kind == LITERAL, surface, MARK[kind])
    plain = np.where(kind == NAME, surface, typed)
    cuts = np.cumsum([len(d) + 1 for d in data])
    line = np.concatenate([[0], np.cumsum(a == 10)])[starts]
    edge = np.diff(line, prepend=-1, append=-1) != 0
    finishes = np.append(begins[1:], True)[: len(starts)]
    words = Tokens(typed, plain, kind, surface, capital, np.searchsorted(cuts, starts, side="right"), edge[:-1], edge[1:], begins, finishes)
    if not len(starts):
        return words, words
    more = np.zeros(len(starts), bool)  # goes on with the name before it
    more[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & (starts[1:] - ends[:-1] == 1) & (a[ends[:-1]] == 32)
    head = np.flatnonzero(~more)
    last = np.append(head[1:], len(starts)) - 1
    whole, kind = span_hash(surface, head, last + 1), kind[head]
    typed = np.where(kind == LITERAL, whole, MARK[kind])
    return words, Tokens(typed, np.where(kind == NAME, whole, typed), kind, whole, capital[head], words.owner[head], words.opens[head], words.closes[last], begins[head], finishes[last])


def windows(t: Tokens, size: int, forms: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, hashes) of all windows of `size` tokens inside one text: typed and then plain, with LITERALS literals or more, and then all, fully literal. Under SHORT tokens they fill a sentence or hold a number, under SHORTEST they are whole lines, fully literal."""
    n = len(t.kind) - size + 1
    if n <= 0:
        return
    at = np.arange(n)
    inside = t.owner[:n] == t.owner[size - 1 :]
    if size < SHORTEST:
        lines = np.cumsum(t.opens)
        own = at[inside & t.opens[:n] & t.closes[size - 1 :] & (lines[:n] == lines[size - 1 :])]
        yield own, span_hash(t.surface, own, own + size)
        return
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    held = lambda x: (total := sums(x))[size:] - total[:-size]
    whole = inside & t.begins[:n] & t.finishes[size - 1 :]
    for k, (values, literal) in enumerate(((t.typed, t.kind == LITERAL), (t.plain, (t.kind == LITERAL) | (t.kind == NAME)), (t.surface, None))[:forms]):
        ok = inside
        if size < SHORT:
            ok = whole | (inside & (held(t.kind == NUMBER) > 0)) if k < 2 else whole
        own = at[ok & (held(literal) >= LITERALS)] if literal is not None else at[ok]
        yield own, span_hash(values, own, own + size)


class Windows:
    """Windows of the items: sorted hashes with item and position, and a bitmap that rules out most lookups."""

    def __init__(self, t: Tokens, items: int, forms: int) -> None:
        self.tokens, self.forms = t, forms
        self.start = np.searchsorted(t.owner, np.arange(items + 1))
        lengths = np.diff(self.start)
        #: different words that a run with changed slots must share
        self.words = np.array([min(WORDS, max(2, len(np.unique(t.surface[a:b][t.kind[a:b] == LITERAL])))) for a, b in pairwise(self.start.tolist())], np.int64)
        self.sizes = sorted({int(min(WINDOW, n)) for n in lengths if n})
        found = []
        for size in self.sizes:
            for at, h in windows(t, size, forms):
                fits = np.minimum(WINDOW, lengths[t.owner[at]]) == size
                found.append((h[fits], at[fits]))
        h, at = (np.concatenate(x) if found else np.empty(0, np.uint64) for x in (zip(*found, strict=True) if found else ((), ())))
        order = np.lexsort((at, h))
        self.hashes, self.at = h[order], at[order].astype(np.int64)
        if len(self.at):
            fresh = np.concatenate([[True], (np.diff(self.hashes.view(np.int64)) != 0) | (np.diff(self.at) != 0)])
            self.hashes, self.at = self.hashes[fresh], self.at[fresh]
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document token, item token and size of all equal windows."""
        found = [(np.empty(0, np.int64),) * 3]
        for size in self.sizes:
            for at, h in windows(t, size, self.forms):
                maybe = np.flatnonzero(self.bitmap[(h >> np.uint64(42)).astype(np.int64)])
                lo = np.searchsorted(self.hashes, h[maybe], side="left")
                count = np.searchsorted(self.hashes, h[maybe], side="right") - lo
                total = int(count.sum())
                each = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(total)
                found.append((np.repeat(at[maybe], count), self.at[each], np.full(total, size)))
        d, i, size = (np.concatenate(x) for x in zip(*found, strict=True))
        return d, i, size

    def runs(self, t: Tokens, cover: int) -> dict[tuple[int, int], tuple[int, int]]:
        """(text, item) -> (tokens covered, slots changed) of the longest consistent run that is long enough."""
        own = self.tokens
        d, i, size = self.hits(t)
        of = np.stack([t.owner[d], own.owner[i], d - i])
        order = np.lexsort((i, i + size, *of[::-1]))
        of, begin, end = of[:, order], i[order], (i + size)[order]
        edge = np.flatnonzero(np.concatenate([[True], (of[:, 1:] != of[:, :-1]).any(axis=0), [True]])) if len(d) else np.zeros(1, int)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for x, y in pairwise(edge.tolist()):
            text, item, shift = of[:, x].tolist()
            anchors = list(zip(end[x:y].tolist(), begin[x:y].tolist(), strict=True))
            lo, hi = int(self.start[item]), int(self.start[item + 1])
            need = min(cover, hi - lo)
            first, stop = np.searchsorted(t.owner, [text, text + 1])
            i = np.arange(max(lo, int(first) - shift), min(hi, int(stop) - shift))
            d = i + shift
            same, kind, other = own.surface[i] == t.surface[d], own.kind[i], t.kind[d]
            agree = same | ((kind == other) & (kind != LITERAL)) | (own.capital[i] & t.capital[d])
            slot = ~same | (kind != LITERAL) | (other != LITERAL)
            word = same & (kind != NUMBER) & (kind != UNIT)
            found = longest(i.tolist(), agree.tolist(), slot.tolist(), own.surface[i].tolist(), t.surface[d].tolist(), anchors, need, word.tolist(), int(self.words[item]))
            if found and (found[0], -found[1]) > (best[text, item][0], -best[text, item][1]) if (text, item) in best else found:
                best[text, item] = found
        return best


def longest(at: list[int], agree: list[bool], slot: list[bool], item: list[int], doc: list[int], anchors: list[tuple[int, int]], need: int, word: list[bool], words: int) -> tuple[int, int] | None:
    """(length, changed) of the longest run of consecutive places that agree, with consistent slots and a whole anchor (end, start) in it, of `need` places at least, and, if slots have changed, with `words` different words."""
    there: dict[int, tuple[int, int]] = {}  # item value -> (document value, where it was last)
    back: dict[int, tuple[int, int]] = {}
    differ: list[int] = []
    last: dict[int, int] = {}  # word -> where it was last
    best, start, reached, anchor = None, None, 0, -1
    for i, ok, is_slot, a, b, is_word in zip(at, agree, slot, item, doc, word, strict=True):
        if not ok:
            start = None
            continue
        if is_word:
            last[a] = i
        if start is None:
            there, back, differ, start = {}, {}, [], i
        if is_slot:
            for held, x, y in ((there, a, b), (back, b, a)):
                if x in held and held[x][0] != y:
                    start = max(start, held[x][1] + 1)
                held[x] = (y, i)
            if a != b:
                differ.append(i)
        while reached < len(anchors) and anchors[reached][0] <= i + 1:
            anchor = max(anchor, anchors[reached][1])
            reached += 1
        # the run as a whole, and its end that is a plain copy
        for begin in (start, max(start, differ[-1] + 1) if differ else start):
            length, changed = i - begin + 1, len(differ) - bisect_left(differ, begin)
            if length >= need and anchor >= begin and (best is None or (length, -changed) > (best[0], -best[1])) and (not changed or sum(x >= begin for x in last.values()) >= words):
                best = length, changed
    return best


class Index:
    """The items' windows by words, and with names of several words as one."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        self.ids = [i for i, _ in items]
        words, names = tokens([x for _, x in items])
        self.parts = (Windows(words, len(items), 3), Windows(names, len(items), 1))

    def find(self, texts: list[str], cover: int) -> dict[tuple[int, int], tuple[int, int]]:
        """(text, item) -> (tokens covered, slots changed)."""
        words, names = tokens(texts)
        out = self.parts[0].runs(words, cover)
        for k, (n, changed) in self.parts[1].runs(names, cover).items():
            if k not in out or (n, -changed) > (out[k][0], -out[k][1]):
                out[k] = n, changed
        return out


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BATCH_BYTES):
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def _scan(index: Index, cover: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts, rows = [x or "" for x in b.column(1).to_pylist()], []
            for lo, hi in _pieces(texts):
                for (text, item), (n, changed) in index.find(texts[lo:hi], cover).items():
                    rows.append((b.column(0)[lo + text].as_py(), index.ids[item], n, changed))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "covered", "changed"])

    return run


def _kept(index: Index, cover: int, at: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts, keep = [x or "" for x in b.column(at).to_pylist()], np.ones(len(b), bool)
            for lo, hi in _pieces(texts):
                keep[[lo + text for text, _ in index.find(texts[lo:hi], cover)]] = False
            yield b.filter(pa.array(keep))

    return run


def _indexes(benchmark: DataFrame, slab_bytes: int) -> Iterator:
    """Broadcast indexes of all items, in slabs of bounded size."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slabs = max(1, -(-total // slab_bytes))
    for k in range(slabs):
        own = sorted(((r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slabs)) == k).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield benchmark.sparkSession.sparkContext.broadcast(Index(own))


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: int = 13, slab_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, covered, changed): one row for every document and item that match."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for shared in _indexes(benchmark, slab_bytes):
        part = rows.mapInArrow(lambda batches, shared=shared: _scan(shared.value, cover)(batches), "doc_id long, item_id long, covered int, changed int")
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, cover: int = 13, slab_bytes: int = 16 << 20) -> DataFrame:
    """docs without the rows whose text matches an item."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for shared in _indexes(benchmark, slab_bytes):
        docs = docs.mapInArrow(lambda batches, shared=shared: _kept(shared.value, cover, at)(batches), docs.schema)
    return docs
