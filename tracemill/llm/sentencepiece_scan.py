"""SentencePiece (BPE model) encoding and decoding as a max-plus scan over chunks.

A byte-pair encoding is the only path through the lattice of vocabulary pieces
in which every two neighbouring pieces are compatible, that is, encoding the
two alone leaves them as they are: a merge across a boundary would also happen
between the two pieces by themselves, and the other way round. So encoding is a
best-path problem in the max-plus semiring with weight -inf for incompatible
neighbours and the piece's score otherwise, and it can be cut anywhere:

1. A giant text is cut into chunks of `chunk` characters, each with the few
   characters on either side that a piece can span.
2. The state at a cut is the piece that covers the last character before it,
   with its overhang. Every chunk yields the transfer matrix from all states
   that its left cut admits to those at its right cut (sparse; mostly one
   entry a row, since paths meet at the first point that no piece can span).
3. Matrices are multiplied associatively: products of blocks of chunks in
   parallel, a scan over the block products, then prefixes within blocks.
4. Each chunk is traced back independently between its two states.

A text of one chunk is the case with a single start and end state. The result
equals the library's for the same model file; the library itself only reads
the file. Between two points that no piece spans the path depends on nothing
else, so all distinct segments of a slice of texts are merged at once: one
array step does the best merge of every segment. Nothing is kept between
slices but the vocabulary and a bounded table of compatible neighbours.

Given cases: null text gives null ids, empty text no ids; characters outside
the vocabulary become byte pieces; repeated rows are encoded each; U+2581 in a
text reads as a blank, as in the library (decoding returns a blank there); an
empty table gives an empty one; other columns are carried along by encode()
and decode(), but for one that has the name of the new column: it is replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.batches import sliced, small_batches, unused
from tracemill.session import stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 15
BLOCK = 64
CACHE = 30_000  # pairs of neighbours, and long segments, that a worker remembers
SLICE, SLICE_BYTES = 512, 2 << 20  # rows and bytes of text that are worked on at a time
WIDE = 48  # characters of a segment that is merged in arrays; longer ones are traced one by one
META = "▁"
MARKS = ".,!?;:"

_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(MARKS.encode())] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True

State = tuple[str, int]
Matrix = dict[State, dict[State, float]]
START: State = ("", 0)


class Vocabulary:
    """The pieces of a model, with blanks written as blanks."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        n = p.get_piece_size()
        self.pieces = [p.id_to_piece(i).replace(META, " ") for i in range(n)]
        plain = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: p.get_score(i) for i in plain}
        self.bytes = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.special = [i for i in range(n) if p.is_control(i) or p.is_unknown(i)]
        self.longest = max(map(len, self.ids))
        #: what lattices are kept by in workers: the same for the same model, whichever broadcast brings it
        self.digest = hashlib.sha256(p.serialized_model_proto()).hexdigest()
        if any(" " in x.lstrip(" ") for x in self.ids):
            raise ValueError("pieces that hold a blank after a letter are not supported")


class Lattice:
    """Paths through a vocabulary; lives in a worker and keeps bounded caches."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.fits, self.pairs, self.words = v, {}, 0, {}
        self._tables()
        #: pieces that can be in an encoding at all: characters, and what their own merges lead to
        self.nodes = {x for x in v.ids if len(x) == 1 or self.merged(x) == [x]}
        #: nodes by character; "" holds the node that ends there
        self.trie: dict = {}
        #: characters that stand side by side in some node
        self.joined = {x[i : i + 2] for x in self.nodes for i in range(len(x) - 1)}
        for x in self.nodes:
            node = self.trie
            for c in x:
                node = node.setdefault(c, {})
            node[""] = x
        # segments end where no piece spans: before a blank run that follows something else, around line breaks,
        # and (if no piece has a letter before such a mark) before the mark after a word
        if "\n" in "".join(v.ids):
            raise ValueError("vocabularies with line breaks in pieces are not supported")
        self.marked = marked = not any(x[1] in MARKS and x[0].isalpha() for x in self.joined)
        self.segment = re.compile((rf" *[^\W\d_]+(?=[ \n{MARKS}]|\Z)|" if marked else "") + r" *[^ \n]+| +|\n")
        self.text = [self._surface(i) for i in range(len(v.pieces))]
        raw = [t.encode("utf-8", "surrogateescape") for t in self.text]
        self.lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        self.offsets, self.bytes = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(raw), np.uint8)

    # -- pieces ---------------------------------------------------------

    def _tables(self) -> None:
        """Symbols are piece ids, and FIRST + code point for characters that are no piece; `keys` has all pairs of symbols that merge, with the piece they make."""
        ids = self.v.ids
        self.first = len(self.v.pieces)
        self.span = self.first + 0x110000
        self.symbol = np.arange(0x110000, dtype=np.int32) + np.int32(self.first)
        for x, i in ids.items():
            if len(x) == 1:
                self.symbol[ord(x)] = i
        of = lambda x: ids.get(x, self.first + ord(x) if len(x) == 1 else None)
        found = [(a * self.span + b, i) for x, i in ids.items() for k in range(1, len(x)) if (a := of(x[:k])) is not None and (b := of(x[k:])) is not None]
        #: a table of slots, found by multiplying the key; further slots follow where one is taken
        self.bits = max(4, (8 * len(found)).bit_length())
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        for key, i in found:
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.made[at] = key, i
        self.rank = np.full(len(self.v.pieces), -1, np.int32)  # order of the scores; -1: never made
        order = {x: k for k, x in enumerate(sorted({self.v.scores[x] for x in ids}))}
        for x, i in ids.items():
            self.rank[i] = order[self.v.scores[x]]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of merging two symbols, rank -1 where they don't; b is negative where there is none."""
        key = a.astype(np.int64) * self.span + b
        at = self._slot(key)
        there = self.keys[at]
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.keys)
            there[open_] = self.keys[at[open_]]
            open_ = open_[(there[open_] != key[open_]) & (there[open_] >= 0)]
        piece = self.made[at]
        return np.where((there == key) & (b >= 0), self.rank[piece], np.int32(-1)), piece

    def merge_all(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols, padded with -1, each merged to the end: the best pair of every row first, then leftmost. Merged-away places become -1."""
        rows, width = symbols.shape
        out = symbols.copy()
        live = np.arange(rows)
        symbols = np.concatenate([symbols, np.full((rows, 1), -1, symbols.dtype)], axis=1)
        after = np.tile(np.arange(1, width + 2, dtype=np.int8), (rows, 1))
        before = np.tile(np.arange(-1, width + 1, dtype=np.int8), (rows, 1))
        rank, piece = np.full((rows, width + 1), -1, np.int32), np.zeros((rows, width + 1), np.int32)
        r, c = np.nonzero(symbols[:, 1:] >= 0)
        rank[r, c], piece[r, c] = self._pair(symbols[r, c], symbols[r, c + 1])
        while len(live):
            i = rank.argmax(axis=1)
            at = np.arange(len(live))
            done = rank[at, i] < 0
            if 4 * np.count_nonzero(done) > len(live) or done.all():  # what is done leaves the arrays
                out[live[done]] = symbols[done, :width]
                live, symbols, after, before, rank, piece, i = (x[~done] for x in (live, symbols, after, before, rank, piece, i))
                at = np.arange(len(live))
            elif done.any():
                at, i = at[~done], i[~done]
            j = after[at, i]
            k = after[at, j]
            symbols[at, i], symbols[at, j], rank[at, j] = piece[at, i], -1, -1
            after[at, i] = k
            before[at, np.minimum(k, width)] = i
            h = before[at, i]
            some = np.flatnonzero(h >= 0)
            # the place `width` holds no symbol, so a pair that ends there has no rank
            left, right = np.concatenate([i, h[some]]), np.concatenate([k, i[some]])
            at = np.concatenate([at, at[some]])
            rank[at, left], piece[at, left] = self._pair(symbols[at, left], symbols[at, np.minimum(right, width)])
        return out

    def merged(self, text: str) -> list[str]:
        """What merging leaves of a short text; best score first, then leftmost."""
        score, none = self.v.scores.get, -np.inf
        parts = list(text)
        pairs = [score(a + b, none) for a, b in pairwise(parts)]
        while pairs and (best := max(pairs)) != none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def compatible(self, a: str, b: str) -> bool:
        if not a:
            return True
        row = self.fits.get(a)
        if row is None:
            row = self.fits[a] = {}
        known = row.get(b)
        if known is None:
            self.pairs += 1
            if self.pairs > CACHE:
                self.pairs = 1
                self.fits = {a: (row := {})}
            known = row[b] = self.merged(a + b) == [a, b]
        return known

    def id_list(self, piece: str) -> list[int]:
        i = self.v.ids.get(piece)
        return [i] if i is not None else [self.v.bytes[b] for b in piece.encode("utf-8", "replace")]

    # -- paths ----------------------------------------------------------

    def forward(self, text: str, start: int, state: str, stop: int) -> list[str | None]:
        """By position up to stop, the last piece of the admissible path from `state` at start (None: no path)."""
        nodes, longest = self.nodes, self.v.longest
        last: list[str | None] = [None] * (stop + 1)
        last[start] = state
        for at in range(start + 1, stop + 1):
            for lo in range(start if at - start <= longest else at - longest, at):
                before = last[lo]
                if before is None:
                    continue
                piece = text[lo:at]
                if (piece in nodes or at - lo == 1) and self.compatible(before, piece):
                    last[at] = piece
                    break
        return last

    def back(self, last: list[str | None], start: int, end: int, final: str | None = None) -> list[str]:
        """The pieces from start to end."""
        out, at = [], end
        while at > start:
            piece = final if final is not None and at == end else last[at]
            out.append(piece)
            at -= len(piece)
        return out[::-1]

    def matches(self, text: str, at: int) -> list[str]:
        """The nodes that text has at a position, shortest first; an unknown character stands for itself."""
        node, out = self.trie, []
        for c in text[at : at + self.v.longest]:
            node = node.get(c)
            if node is None:
                break
            if (piece := node.get("")) is not None:
                out.append(piece)
        return out if out and len(out[0]) == 1 else [text[at], *out]

    def path(self, text: str) -> list[str]:
        """The admissible path through a whole segment, depth first.

        Any run of compatible pieces from the start is the encoding of what it
        covers, so a position can be reached in one way only: one that leads
        nowhere is dead for good. Long pieces first, as they mostly belong.
        """
        n, at, before = len(text), 0, ""
        pieces: list[str] = []
        left: list[list[str]] = []
        dead: set[int] = set()
        options = self.matches(text, 0)
        row: dict[str, bool] = {}
        while at < n:
            if options:
                piece = options.pop()
                known = row.get(piece)
                if known is None:
                    known = self.compatible(before, piece)
                if known and (not dead or at + len(piece) not in dead):
                    pieces.append(piece)
                    left.append(options)
                    at += len(piece)
                    if at < n:
                        before, options = piece, self.matches(text, at)
                        row = self.fits.get(piece, {})
            else:
                dead.add(at)
                at -= len(pieces.pop())
                options = left.pop()
                before = pieces[-1] if pieces else ""
                row = self.fits.get(before, {})
        return pieces

    def word(self, segment: str) -> list[int]:
        """Ids of a long segment that no piece crosses; it is divided where its neighbouring characters stand together in no piece."""
        found, lo, joined = self.words.get(segment), 0, self.joined
        if found is None:
            found = []
            for i in range(1, len(segment) + 1):
                if i == len(segment) or segment[i - 1 : i + 1] not in joined:
                    found += chain.from_iterable(map(self.id_list, self.path(segment[lo:i])))
                    lo = i
            if len(segment) <= 4 * WIDE:
                if len(self.words) >= CACHE:
                    self.words.clear()
                self.words[segment] = found
        return found

    def segments(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cuts) of segments, data[ends[i - 1]:ends[i]]: the ids of segment i are ids[cuts[i]:cuts[i + 1]]."""
        chars = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        hi = heads[ends]
        size = np.diff(hi, prepend=0)
        lo = hi - size
        symbols = self.symbol[chars]
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # segment, place in it, id
        least = 0
        for most in (6, 10, 16, 28, WIDE):
            own = np.flatnonzero((size > least) & (size <= most))
            least = most
            for part in np.array_split(own, -(-len(own) // 50_000) or 1):
                if len(part):
                    place = np.arange(most)
                    there = place < size[part, None]
                    got = self.merge_all(np.where(there, symbols[np.minimum(lo[part, None] + place, len(symbols) - 1)], -1))
                    r, c = np.nonzero(got >= 0)
                    kept.append((part[r], c, got[r, c]))
        long = np.flatnonzero(size > WIDE)
        lists = [self.word(data[(ends[i - 1] if i else 0) : ends[i]].decode("utf-8", "replace")) for i in long]
        if len(long):
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            kept.append((np.repeat(long, n), _spread(np.zeros(len(n), np.int64), n), np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum()))))
        at, place, ids = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((place, at))
        at, ids = at[order], ids[order].astype(np.int64)
        if len(odd := np.flatnonzero(ids >= self.first)):  # characters outside the vocabulary: byte pieces
            each = [self.id_list(chr(x - self.first)) for x in ids[odd]]
            n = np.ones(len(ids), np.int64)
            n[odd] = [len(x) for x in each]
            fresh = np.repeat(ids, n)
            fresh[_spread((np.cumsum(n) - n)[odd], n[odd])] = np.fromiter(chain.from_iterable(each), np.int64, int(n[odd].sum()))
            at, ids = np.repeat(at, n), fresh
        return ids.astype(np.int32), np.searchsorted(at, np.arange(len(ends) + 1))

    def encode(self, text: str) -> list[int]:
        """Ids of a text (with its leading blank) that is one chunk."""
        return self._flat([text.encode("utf-8", "replace")])[0].tolist()

    def _flat(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of texts of one chunk each. Segments are cut, and equal ones found, over all texts at once."""
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        opens = np.concatenate([[0], np.cumsum(sizes)])
        joined = b"".join(data)
        a = np.frombuffer(joined, np.uint8)
        if not len(a):
            return np.zeros(0, np.int32), np.zeros(len(data), np.int64)
        blank, line = a == 32, a == 10
        starts = np.zeros(len(a), bool)
        starts[1:] = (blank[1:] & ~blank[:-1]) | line[1:] | line[:-1]
        if self.marked:
            starts[1:] |= _MARK[a[1:]] & _LETTER[a[:-1]]
        starts[opens[:-1][sizes > 0]] = True
        at = np.flatnonzero(starts)
        offsets = np.append(at, len(a)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        code, distinct = words.indices.to_numpy(), words.dictionary
        ends = np.frombuffer(distinct.buffers()[1], np.int32)[1 : len(distinct) + 1]
        pool, cuts = self.segments(distinct.buffers()[2].to_pybytes()[: ends[-1]], ends)
        n = np.diff(cuts)[code]
        flat = pool[_spread(cuts[:-1][code], n)]
        total = np.concatenate([[0], np.cumsum(n)])
        return flat, np.diff(total[np.searchsorted(at, opens)])

    def encode_all(self, texts: list[str | None]) -> pa.ListArray:
        """Ids of texts of one chunk each."""
        flat, counts = self._flat([b"" if t is None else surface(t).encode("utf-8", "replace") for t in texts])
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.array([*[t is None for t in texts], False])), pa.array(flat, pa.int32()))

    def decode_all(self, rows: pa.ListArray) -> pa.Array:
        """Texts of lists of ids, by gathering the bytes of all pieces at once; lists with bytes that are no UTF-8 are decoded one by one."""
        if rows.null_count or not len(rows):
            return pa.array([None if x is None else self.decode(x) for x in rows.to_pylist()], pa.string())
        ids = rows.flatten().to_numpy(zero_copy_only=False)
        counts = rows.value_lengths().to_numpy(zero_copy_only=False)
        size = self.lengths[ids]
        out = self.bytes[_spread(self.offsets[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        filled = ends[1:] > ends[:-1]
        first = ends[:-1][filled]
        drop = np.zeros(len(out), bool)
        drop[first] = out[first] == 32
        gone = np.concatenate([[0], np.cumsum(drop)])
        offsets = (ends - gone[ends]).astype(np.int32)
        text = pa.Array.from_buffers(pa.string(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(out[~drop].tobytes())])
        try:
            text.validate(full=True)
        except pa.ArrowInvalid:
            return pa.array([self.decode(x) for x in rows.to_pylist()], pa.string())
        return text

    # -- chunks ---------------------------------------------------------

    def cuts(self, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """First and last point in [lo, hi) before which a segment ends, or None."""
        at = [p for p in (m.start() for m in self.segment.finditer(text)) if lo <= p < hi and p > 0]
        return (at[0], at[-1]) if at else None

    def states(self, left: str, ahead: str) -> list[State]:
        """All states at the point between left and ahead."""
        if not left:
            return [START]
        text, p, out = left + ahead, len(left), []
        for lo in range(max(0, p - self.v.longest), p):
            for hi in range(p, min(len(text), lo + self.v.longest) + 1):
                piece = text[lo:hi]
                if piece in self.nodes or len(piece) == 1:
                    out.append((piece, hi - p))
        return out

    def score(self, pieces: list[str]) -> float:
        return float(sum(self.v.scores.get(x, 0.0) for x in pieces))

    def exits(self, text: str, last: list[str | None], size: int, final: bool) -> list[tuple[State, int]]:
        """States at the point `size` that a run reaches, with where their piece ends."""
        found = []
        for end in range(size, len(last)):
            piece = last[end]
            if piece and end - len(piece) < size and (not final or end == size):
                found.append(((piece, end - size), end))
        return found

    def matrix(self, left: str, body: str, right: str) -> Matrix:
        size, text, final = len(body), body + right, not right
        bound = self.cuts(text, 0 if left and left[-1] != " " and body.startswith(" ") else 1, size)
        out: Matrix = {}
        if bound is None:
            for piece, over in self.states(left, text):
                if over >= size and over > 0:
                    out[piece, over] = {(piece, over - size): 0.0}
                    continue
                last = self.forward(text, over, piece, len(text))
                row = {s: self.score(self.back(last, over, end)) for s, end in self.exits(text, last, size, final)}
                if row:
                    out[piece, over] = row
            return out
        b1, b2 = bound
        tail = self.forward(text[b2:], 0, "", len(text) - b2)
        ends = {s: self.score(self.back(tail, 0, end)) for s, end in self.exits(text, tail, size - b2, final)}
        for piece, over in self.states(left, text):
            if over <= b1:
                last = self.forward(text, over, piece, b1)
                if last[b1] is not None:
                    head = self.score(self.back(last, over, b1))
                    out[piece, over] = {s: head + x for s, x in ends.items()}
        return out

    def trace(self, left: str, body: str, right: str, enter: State, leave: State) -> list[int]:
        """Ids of the pieces that start in body, between the two states."""
        size, text, over = len(body), body + right, enter[1]
        end = size + leave[1]
        bound = self.cuts(text, 0 if left and left[-1] != " " and body.startswith(" ") else 1, size)
        if bound is None:
            if over >= size and over > 0:
                return []
            pieces = self.back(self.forward(text, over, enter[0], end), over, end)
            return list(chain.from_iterable(map(self.id_list, pieces)))
        b1, b2 = bound
        head = self.back(self.forward(text, over, enter[0], b1), over, b1)
        tail = self.back(self.forward(text[b2:end], 0, "", end - b2), 0, end - b2)
        out = list(chain.from_iterable(map(self.id_list, head)))
        out += self.encode(text[b1:b2])
        return out + list(chain.from_iterable(map(self.id_list, tail)))

    # -- decoding -------------------------------------------------------

    def _surface(self, i: int) -> str:
        v = self.v
        if i in v.special:
            return ""
        for b in (v.bytes.index(i),) if i in v.bytes else ():
            return chr(b) if b < 128 else chr(0xDC00 + b)
        return v.pieces[i]

    def decode(self, ids: list[int]) -> str:
        s = "".join(map(self.text.__getitem__, ids))
        if not s.isascii():
            s = s.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return s.removeprefix(" ")


def product(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product; absent entries are -inf."""
    out: Matrix = {}
    for s, row in a.items():
        best: dict[State, float] = {}
        for m, x in row.items():
            for e, y in b.get(m, {}).items():
                best[e] = max(best.get(e, -np.inf), x + y)
        if best:
            out[s] = best
    return out


def _dump(m: Matrix) -> str:
    return json.dumps([[*s, [[*e, x] for e, x in row.items()]] for s, row in m.items()])


def _load(s: str) -> Matrix:
    return {(p, o): {(q, n): x for q, n, x in row} for p, o, row in json.loads(s)}


_lattices: dict[str, Lattice] = {}


def _lattice(shared: _Shared) -> Lattice:
    """One lattice a worker, of the model that was used last."""
    if shared.digest not in _lattices:
        _lattices.clear()
        _lattices[shared.digest] = Lattice(shared.held.value)
    return _lattices[shared.digest]


class _Shared:
    """A broadcast vocabulary and its digest, which a worker knows before it unpacks it."""

    def __init__(self, df: DataFrame, v: Vocabulary) -> None:
        self.held, self.digest = df.sparkSession.sparkContext.broadcast(v), v.digest


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (sizes[i] of them) for all i in a row."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _lists(rows: list[list[int] | None]) -> pa.Array:
    sizes = [len(r) if r is not None else 0 for r in rows]
    flat = np.fromiter(chain.from_iterable(r for r in rows if r), np.int32, sum(sizes))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.int32(), mask=np.array([*[r is None for r in rows], False]))
    return pa.ListArray.from_arrays(offsets, pa.array(flat))


def surface(text: str) -> str:
    """The text as the lattice reads it: a leading blank, and U+2581 as a blank."""
    return " " + text.replace(META, " ") if text else ""


def _cut(chunk: int, halo: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = surface(text)
                rows = [(key, i, t[max(0, lo - halo) : lo], t[lo : lo + chunk], t[lo + chunk : lo + chunk + halo]) for i, lo in enumerate(range(0, len(t), chunk))]
                for lo in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[lo : lo + 256], strict=True)], names=["key", "k", "left", "body", "right"])

    return run


def _matrices(shared: _Shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = _lattice(shared)
        for b in batches:
            out = [_dump(lat.matrix(*r)) for r in zip(*[b.column(i).to_pylist() for i in (2, 3, 4)], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], names=["key", "k", "m"])

    return run


def _block_product(t: pa.Table) -> pa.Table:
    rows = sorted(zip(t.column("k").to_pylist(), t.column("m").to_pylist(), strict=True))
    m = _load(rows[0][1])
    for _, x in rows[1:]:
        m = product(m, _load(x))
    return pa.table({"key": t.column("key")[:1], "block": t.column("block")[:1], "m": [_dump(m)]})


def _resolve(rows: list[tuple[int, Matrix]], first: State, last: State | None) -> list[tuple[int, State, State]]:
    """States at both sides of each of the consecutive matrices, from the first state and, if known, the last."""
    ahead = [{first: 0.0}]
    for _, m in rows:
        row: dict[State, float] = {}
        for s, x in ahead[-1].items():
            for e, y in m.get(s, {}).items():
                row[e] = max(row.get(e, -np.inf), x + y)
        ahead.append(row)
    end = last if last is not None else max(ahead[-1].items(), key=lambda x: (x[1], x[0]))[0]
    out = []
    for i in range(len(rows) - 1, -1, -1):
        m = rows[i][1]
        start = max((s for s in ahead[i] if end in m.get(s, {})), key=lambda s: (ahead[i][s] + m[s][end], s))
        out.append((rows[i][0], start, end))
        end = start
    return out[::-1]


def _table(key: pa.Scalar, name: str, found: list[tuple[int, State, State]]) -> pa.Table:
    n = len(found)
    return pa.table({"key": pa.array([key.as_py()] * n), name: pa.array([x[0] for x in found], pa.int64()), "in_piece": [x[1][0] for x in found], "in_over": pa.array([x[1][1] for x in found], pa.int64()), "out_piece": [x[2][0] for x in found], "out_over": pa.array([x[2][1] for x in found], pa.int64())})


def _scan_blocks(t: pa.Table) -> pa.Table:
    rows = [(b, _load(m)) for b, m in sorted(zip(t.column("block").to_pylist(), t.column("m").to_pylist(), strict=True))]
    return _table(t.column("key")[0], "block", _resolve(rows, START, None))


def _scan_chunks(t: pa.Table) -> pa.Table:
    rows = [(k, _load(m)) for k, m in sorted(zip(t.column("k").to_pylist(), t.column("m").to_pylist(), strict=True))]
    g = lambda c: t.column(c)[0].as_py()
    return _table(t.column("key")[0], "k", _resolve(rows, (g("in_piece"), g("in_over")), (g("out_piece"), g("out_over"))))


def _traces(shared: _Shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = _lattice(shared)
        for b in batches:
            out = [lat.trace(left, body, right, (a, i), (z, o)) for left, body, right, a, i, z, o in zip(*[b.column(c).to_pylist() for c in range(2, 9)], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(out)], names=["key", "k", "ids"])

    return run


def _single(shared: _Shared, at: int, schema: T.StructType, decoded: bool) -> callable:
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = _lattice(shared)
        for part in sliced(batches, SLICE, SLICE_BYTES):
            ids = lat.encode_all(part.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, ids, *([lat.decode_all(ids)] if decoded else [])], names=names)

    return run


def encode(docs: DataFrame, model: str = MODEL, into: str = "ids", chunk: int = CHUNK, decoded: str | None = None) -> DataFrame:
    """docs (with text) and, in a new column, the ids of the whole text. decoded: a further column with the text of these ids, made by the same Python worker."""
    small_batches(docs.sparkSession)
    docs = docs.drop(into, *([decoded] if decoded else []))
    v = Vocabulary(model)
    shared = _Shared(docs, v)
    row, other, list_ = unused(docs.withColumn(into, F.lit(0)), "__key", "__key2", "__ids")
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])])
    giant = F.coalesce(F.char_length("text") >= chunk, F.lit(False))
    at = docs.columns.index("text")
    small = docs.where(~giant).mapInArrow(_single(shared, at, schema, decoded is not None), schema)

    rows = stored(docs.where(giant).withColumn(row, F.monotonically_increasing_id()), "giant-texts")
    chunks = rows.select(F.col(row).alias("key"), "text").mapInArrow(_cut(chunk, v.longest), "key long, k long, left string, body string, right string")
    chunks = stored(chunks.repartition(F.xxhash64("key", "k")), "giant-chunks")
    matrices = stored(chunks.mapInArrow(_matrices(shared), "key long, k long, m string").withColumn("block", F.floor(F.col("k") / BLOCK).cast("long")), "giant-matrices")
    products = matrices.groupBy("key", "block").applyInArrow(_block_product, "key long, block long, m string")
    states = "in_piece string, in_over long, out_piece string, out_over long"
    blocks = products.groupBy("key").applyInArrow(_scan_blocks, f"key long, block long, {states}")
    ends = matrices.join(blocks, ["key", "block"]).groupBy("key", "block").applyInArrow(_scan_chunks, f"key long, k long, {states}")
    traced = chunks.join(ends, ["key", "k"]).mapInArrow(_traces(shared), "key long, k long, ids array<int>")
    whole = traced.groupBy(F.col("key").alias(other)).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias(list_))
    found = rows.join(whole, F.col(row) == F.col(other)).select(*[rows[c] for c in docs.columns], F.col(list_).alias(into))
    return small.union(decode(found, model, into, decoded) if decoded else found)


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """rows with the text of their ids in a new column; null ids give null."""
    small_batches(rows.sparkSession)
    rows = rows.drop(into)
    shared = _Shared(rows, Vocabulary(model))
    at = rows.columns.index(ids)
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = _lattice(shared)
        for part in sliced(batches, SLICE, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([*part.columns, lat.decode_all(part.column(at))], names=schema.names)

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str = MODEL, **params) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as text, comma-joined) and whether decoding gives the text back; null text has no tokens and is null throughout."""
    done = encode(docs.select("doc_id", "text"), model, decoded="decoded", **params)
    return done.select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n_tokens"), F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"), (F.col("decoded") == F.col("text")).alias("round_trip"))
