"""Vector bin packing of tokenised examples into sequences.

A sequence has three capacities: tokens, segments and loss-bearing tokens.  With a sequence open, the
example goes in next that fits and whose demand vector has the largest dot product with what is left of the
capacities (both as shares), so that scarce capacities are used by those who need little of them.  When
nothing fits, or when one segment is left, an example is cut: the one that gives the most tokens within what is left.
A sequence that a limit closes early is cut into lengths that are powers of two, which need no padding, unless its
padding is small; so is the last one of a task.

Which tokens bear loss is told by a mask.  ``first_quarter_is_prompt`` reads a document as instruction data: the
first quarter of its tokens is the prompt and bears no loss.

Each task packs its own partition as it streams by; of each Arrow batch all but the last POOL_SEQUENCES
sequences' worth of pieces is packed, the rest waits for the next.

Defined cases: a null or empty text is its end mark alone; repeated rows are examples each; of examples with the
same demand the one that came last goes first, and of equal products the shorter example; texts of any length are
tokenised whole; an empty table gives an empty result; further columns, whatever their names, are ignored; doc_id
must be an integer (any other type is refused).
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import arrow_map, filled, integer_id
from .textkit import SLICE_ROWS

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 2048, 16, 1792
#: A cut of fewer tokens isn't worth a segment; a sequence with less padding than this part of it isn't cut up.
LEAST_CUT, SMALL_PADDING = 8, 32
POOL_SEQUENCES = 32
END = 1
#: Bytes of word pieces and their ids that a Python worker remembers, and the longest such piece.
MEMORY, REMEMBERED = 64 << 20, 32
TEXTS = 500
#: Read one way and the other when a tokenizer is loaded.
PROBE = [
    "The  quick\tBROWN fox's naïve café-au-lait,\u00a0don't stop!? 3.14 x_y (a+b)=c; e.g. http://a.b/c?d=1&e",
    "ABC123def 日本語テスト ÀÉÎ straße\r\nnew-line...done \x1c odd \x85 space \u2028 \u3000 '' `` -- 'tis we'll",
]

#: Where an ASCII letter meets ASCII punctuation or a digit, the tokenizer's pattern splits anyway; an
#: apostrophe may belong to a contraction.
_SEAM = re.compile(rb"([a-z])(?=[!-&(-@\[-`{-~])")


def _byte_alphabet() -> dict[int, int]:
    """Byte-level tokenizers write a byte as a printable character: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in plain)}


BYTE_ALPHABET = _byte_alphabet()


class WordEncoder:
    """The tokenizer's ids of whole texts, by way of pieces between white space, each encoded once.

    This is right for a normaliser that lower-cases and a pattern that never look across white space, and that split
    where a letter meets punctuation; whether the pieces' ids in a row are the text's is tried on PROBE when a
    definition is read, and where they aren't, and in texts that may hold a special token's string, texts are encoded as
    they are.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel
        self.tokenizer = Tokenizer.from_str(definition)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.held, self.by_word = 0, True
        self.by_word = all(self.encode([x.encode()])[0].tolist() == self.tokenizer.encode(x, add_special_tokens=False).ids for x in PROBE)

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces; lower-case Latin words, which the normaliser and pattern leave whole, go straight to
        the tokenizer's model in its byte alphabet."""
        out: list[bytes] = [b""] * len(pieces)
        tokenize, slow = self.tokenizer.model.tokenize, []
        for i, piece in enumerate(pieces):
            word = piece.decode()
            if word.isalpha() and (word.isascii() and word.islower() or max(word) < "\u0250" and word == word.lower() and is_normalized("NFC", word)):
                out[i] = array(self.code, [t.id for t in tokenize(word if len(word) == len(piece) else piece.decode("latin-1").translate(BYTE_ALPHABET))]).tobytes()
            else:
                slow.append((i, word))
        got = self.tokenizer.encode_batch_fast([w for _, w in slow], add_special_tokens=False) if slow else []
        for (i, _), e in zip(slow, got, strict=True):
            out[i] = array(self.code, e.ids).tobytes()
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.by_word:
            return [self._whole(t) for t in texts]
        if any(s in t for s in self.special for t in texts):
            return [self._whole(t) if any(s in t for s in self.special) else self.encode([t])[0] for t in texts]
        split = [_SEAM.sub(rb"\1 ", t.lower()).split() for t in texts]
        look = self.known.get
        ids = [list(map(look, s)) for s in split]  # one look-up for each piece; most are known
        holes = [(i, [j for j, v in enumerate(x) if v is None]) for i, x in enumerate(ids) if None in x]
        if holes:
            missing = list({split[i][j] for i, at in holes for j in at})
            own = dict(zip(missing, self._encode(missing), strict=True))
            for piece, v in own.items():
                if self.held >= MEMORY:
                    break
                if len(piece) <= REMEMBERED:  # 200: two objects and their place in the dictionary
                    self.known[piece] = v
                    self.held += len(piece) + len(v) + 200
            for i, at in holes:
                x, s = ids[i], split[i]
                for j in at:
                    x[j] = own[s[j]]
        return [np.frombuffer(b"".join(x), self.dtype) for x in ids]

    def _whole(self, text: bytes) -> np.ndarray:
        ids = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        return np.array(ids, self.dtype)


def first_quarter_is_prompt(ids: np.ndarray) -> np.ndarray:
    """Flags of the loss-bearing tokens of a document (its end mark included): all but its first quarter."""
    return np.arange(len(ids)) >= len(ids) // 4


class Piece:
    """Some tokens of an example that go together: ``before[i]`` loss-bearing ones are among its first i."""

    __slots__ = ("before", "ids", "key", "start", "total")

    def __init__(self, key, start: int, ids: np.ndarray, before: np.ndarray, total: int):
        self.key, self.start, self.ids, self.before, self.total = key, start, ids, before, total

    @property
    def kind(self) -> tuple[int, int, int]:
        """Tokens, loss-bearing tokens, and how many tokens come before the first of these."""
        return len(self.ids), int(self.before[-1] - self.before[0]), int(np.searchsorted(self.before, self.before[0], "right")) - 1

    def within(self, tokens: int, loss: int) -> int:
        """The most leading tokens that keep both limits."""
        return min(len(self.ids), tokens, int(np.searchsorted(self.before, self.before[0] + loss, "right")) - 1)

    def cut(self, n: int) -> tuple[Piece, Piece | None]:
        if n >= len(self.ids):
            return self, None
        first = Piece(self.key, self.start, self.ids[:n], self.before[: n + 1], self.total)
        return first, Piece(self.key, self.start + n, self.ids[n:], self.before[n:], self.total)


class Packer:
    """Places pieces; ``out`` gets (key, start, length, crc, total, loss-bearing tokens, sequence, offset) rows."""

    def __init__(self, tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS):
        self.tokens, self.segments, self.loss = tokens, segments, loss
        self.sequence, self.out = 0, []
        self.kinds: dict[tuple[int, int, int], list[Piece]] = {}
        self.waiting = 0

    def add(self, key, ids: np.ndarray, bears: np.ndarray | None = None) -> None:
        """An example; ``bears`` flags its loss-bearing tokens (None: all).  One that no sequence can take whole is
        cut into pieces that one can."""
        before = np.zeros(len(ids) + 1, np.int32)
        np.cumsum(np.ones(len(ids), np.int32) if bears is None else bears, out=before[1:])
        rest = Piece(key, 0, ids, before, len(ids))
        while rest is not None:
            piece, rest = rest.cut(max(1, rest.within(self.tokens, self.loss)))
            self._hold(piece)

    def _hold(self, piece: Piece) -> None:
        self.kinds.setdefault(piece.kind, []).append(piece)
        self.waiting += len(piece.ids)

    def _emit(self, pieces: list[Piece]) -> None:
        at = 0
        for p in pieces:
            loss = int(p.before[-1] - p.before[0])
            self.out.append((p.key, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, loss, self.sequence, at))
            at += len(p.ids)
        self.sequence += 1

    def pack(self, keep: int = 0) -> None:
        """Fill sequences until no more than ``keep`` tokens wait."""
        pool = _Pool(self.kinds)
        while self.waiting > keep:
            left, held = [self.tokens, self.segments, self.loss], []
            while left[0] and left[1]:
                piece = self._next(pool, left, bool(held))
                if piece is None:
                    break
                left[0], left[1], left[2] = left[0] - len(piece.ids), left[1] - 1, left[2] - int(piece.before[-1] - piece.before[0])
                held.append(piece)
            if 0 < left[0] and left[0] * SMALL_PADDING > self.tokens:
                self._powers(held)
            else:
                self._emit(held)
        self.kinds = {k: v for k, v in self.kinds.items() if v}

    def _next(self, pool: _Pool, left: list[int], open_: bool) -> Piece | None:
        shares = (left[0] / self.tokens**2, left[1] / self.segments**2, left[2] / self.loss**2)
        i = pool.best(left, shares)
        if i is not None and (left[1] > 1 or pool.kinds[i][0] == left[0]):
            return self._take(pool, i)
        # nothing fits whole, or this is the last segment: cut, where that gives more
        j, n = pool.longest(left)
        if i is not None and (j is None or pool.kinds[i][0] >= n):
            return self._take(pool, i)
        if j is None or (open_ and n < min(LEAST_CUT, left[0])):
            return None
        piece = self._take(pool, j)
        first, rest = piece.cut(max(1, piece.within(left[0], left[2])))
        if rest is not None:
            pool.put(rest)
            self.waiting += len(rest.ids)
        return first

    def _take(self, pool: _Pool, i: int) -> Piece:
        piece = pool.take(i)
        self.waiting -= len(piece.ids)
        return piece

    def _powers(self, held: list[Piece]) -> None:
        """Cut what is held into sequences whose lengths are powers of two."""
        n, held = sum(len(p.ids) for p in held), held[::-1]
        for bit in range(n.bit_length() - 1, -1, -1):
            if not n >> bit & 1:
                continue
            want, out = 1 << bit, []
            while want:
                piece, rest = held.pop().cut(want)
                if rest is not None:
                    held.append(rest)
                out.append(piece)
                want -= len(piece.ids)
            self._emit(out)


class _Pool:
    """Waiting pieces by kind, with the kinds as arrays to choose from."""

    def __init__(self, pieces: dict[tuple[int, int, int], list[Piece]]):
        self.pieces = pieces
        self.kinds = sorted(pieces)
        self.place = {k: i for i, k in enumerate(self.kinds)}
        self.size = np.array(self.kinds, float).reshape(-1, 3)
        self.count = np.array([len(pieces[k]) for k in self.kinds], int)
        self.gone = 0

    def best(self, left: list[int], shares: tuple) -> int | None:
        """The kind that fits with the largest dot product."""
        tokens, loss = self.size[:, 0], self.size[:, 1]
        fits = (self.count > 0) & (tokens <= left[0]) & (loss <= left[2])
        i = int(np.where(fits, tokens * shares[0] + shares[1] + loss * shares[2], -1.0).argmax()) if len(fits) else 0
        return i if len(fits) and fits[i] else None

    def longest(self, left: list[int]) -> tuple[int | None, int]:
        """The kind whose beginning gives the most tokens, and how many at least; of equal ones the longest."""
        reach = np.minimum(np.minimum(self.size[:, 0], left[0]), self.size[:, 2] + left[2])
        reach = np.where(self.count > 0, reach * 1e6 + self.size[:, 0], -1.0)
        i = int(reach.argmax()) if len(reach) else 0
        if not len(reach) or reach[i] < 1e6:
            return None, 0
        return i, int(reach[i] // 1e6)

    def take(self, i: int) -> Piece:
        self.count[i] -= 1
        piece = self.pieces[self.kinds[i]].pop()
        if not self.count[i]:
            self.gone += 1
            if self.gone > 64 and 2 * self.gone > len(self.kinds):
                self._shrink()
        return piece

    def put(self, piece: Piece) -> None:
        kind = piece.kind
        self.pieces.setdefault(kind, []).append(piece)
        if kind in self.place:
            i = self.place[kind]
            self.gone -= not self.count[i]
            self.count[i] += 1
        else:
            self.place[kind] = len(self.kinds)
            self.kinds.append(kind)
            self.size, self.count = np.vstack([self.size, kind]), np.append(self.count, 1)

    def _shrink(self) -> None:
        """Leave out kinds that no piece is of any more."""
        kept = np.flatnonzero(self.count)
        self.kinds = [self.kinds[i] for i in kept]
        self.place = {k: i for i, k in enumerate(self.kinds)}
        self.size, self.count, self.gone = self.size[kept], self.count[kept], 0


_encoders: dict[str, WordEncoder] = {}


def worker_encoder(name: str, shared: Broadcast) -> WordEncoder:
    """This worker's encoder, with the pieces that it knows from earlier tasks.

    A function of the module, as one made inside another is sent with a copy of the globals that it names.
    """
    if name not in _encoders:
        _encoders[name] = WordEncoder(shared.value)
    return _encoders[name]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def pack_documents(
    docs: DataFrame, tokenizer: str, end: int = END, tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS, mask: Callable[[np.ndarray], np.ndarray] | None = first_quarter_is_prompt
) -> DataFrame:
    """Pieces of all documents and their places in sequences.  ``mask`` flags the loss-bearing ones of a document's
    ids, end mark included (None: all of them)."""
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary of fixed size

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder, packer = worker_encoder(tokenizer, shared), Packer(tokens, segments, loss)
        first = TaskContext.get().partitionId() << 40
        mark = np.array([end], encoder.dtype)

        def rows():
            columns = list(zip(*packer.out, strict=True)) if packer.out else [[]] * len(NAMES)
            packer.out = []
            arrays = [pa.array(c, pa.int64()) for c in columns]
            arrays[6] = pa.array(np.array(columns[6], np.int64) + first)
            return pa.RecordBatch.from_arrays(arrays, NAMES)

        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                keys, texts = part.column(0).to_pylist(), part.column(1).cast(pa.binary())
                for j in range(0, len(keys), TEXTS):
                    for key, ids in zip(keys[j:], encoder.encode(texts.slice(j, TEXTS).to_pylist()), strict=False):
                        ids = np.concatenate([ids, mark])
                        packer.add(key, ids, None if mask is None else mask(ids))
                packer.pack(POOL_SEQUENCES * tokens)
                yield rows()
        packer.pack()
        yield rows()

    return arrow_map(docs.select(integer_id(docs, "doc_id"), filled().alias("text")), run, SCHEMA)
