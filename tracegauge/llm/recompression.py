"""Substring dedup by recompression: equal stretches of words get equal names, and shared names show what repeats.

A text's words are named by fingerprints.  In every round, first each run of one name becomes one name (of the name and
its length), then each pair of adjacent names, the first of which falls to the left half of a drawn split of all names and
the second to the right half, becomes one name.  A name is a fingerprint of what it stands for, so that all tasks of a
cluster give the same names without a table of them; the split of a round is drawn from the name as well.

What a stretch of words looks like after a round doesn't depend on its surroundings, but for a run and a symbol at
either end.  So every window of WINDOW words has an interior of symbols that all its occurrences share; it is followed
round by round, down to the last round in which something is left of it.  The longest two adjacent symbols of that
interior (those of least name if others are as long, then the first) are the window's anchor.  Adjacent windows with one
anchor form a span.  Equal windows have equal anchors; so:

* a span whose words also occur as a span of an earlier document is a repeat as a whole; of each distinct span, only the
  earliest document's is looked into any further;
* and only if spans of different words share its anchor.  Then all its windows are compared, by anchor and fingerprint.

Rows that move are spans, not words.  Fingerprints of spans and windows have 64 bits and are compared within an anchor's
name, another 64.  Pre-aggregated minima and joins do all of it: a span or window that very many documents have is one
row of the minima, and the joins that hand it out are of written tables, which adaptive execution splits.

Defined cases: a null or empty text has no words and nothing removed; a null doc_id sorts last (as the greatest long)
and is given back as null; rows of one doc_id don't remove each other's words, being no smaller; repeats within a
document stay; texts of any length are read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, filled, integer_id, shared_folder
from .textkit import SLICE_ROWS, Chunk, chunks, mix

WINDOW, ROUNDS = 50, 3
#: Adjacent symbols of an anchor: so that a phrase of a few words isn't one.
TOGETHER = 2
LAST = 2**63 - 1
_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)


def _best(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The first place of the greatest key in each range [lo, hi), by doubling."""
    out = np.zeros(len(lo), np.int64)
    table, width = np.arange(len(key)), 1
    size = hi - lo
    while len(lo) and width <= size.max():
        at = np.flatnonzero((size >= width) & (size < 2 * width))
        a, b = table[lo[at]], table[hi[at] - width]
        out[at] = np.where(key[a] >= key[b], a, b)
        left, right = table[: max(len(table) - width, 0)], table[width:]
        table, width = np.where(key[left] >= key[right], left, right), 2 * width
    return out


def anchors(words: np.ndarray, at: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows that start ``at`` these words: the anchor's first word, its length in words and its name."""
    place, length, name = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), np.uint64)
    symbol, first, size = words, np.arange(len(words)), np.ones(len(words), np.int64)
    alive, lo, hi = np.arange(len(at)), at.copy(), at + window

    def settle(which: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        # of adjacent symbols, where there are as many, else of those that there are
        taken = np.minimum(hi - lo, TOGETHER)
        for k in np.unique(taken):
            own = taken == k
            n = len(symbol) - k + 1
            group, words_of = symbol[:n], size[:n]
            for j in range(1, k):
                group, words_of = mix(group * np.uint64(_BASE) + symbol[j : j + n]), words_of + size[j : j + n]
            key = (np.minimum(words_of, (1 << 20) - 1).astype(np.uint64) << np.uint64(44)) | (~group >> np.uint64(20))
            i = _best(key, lo[own], hi[own] - k + 1)
            place[which[own]], length[which[own]], name[which[own]] = first[i], words_of[i], group[i]

    with np.errstate(over="ignore"):
        for r in range(rounds):
            if not len(alive):
                break
            opens = np.ones(len(symbol), bool)
            opens[1:] = symbol[1:] != symbol[:-1]
            head = np.flatnonzero(opens)
            run = np.cumsum(opens) - 1
            count = np.diff(np.append(head, len(symbol)))
            runs = np.where(count > 1, mix(symbol[head] ^ mix(count.astype(np.uint64) + np.uint64(1 << 40))), symbol[head])
            left = (mix(runs + np.uint64(r + 1)) & np.uint64(1)).astype(bool)
            second = np.zeros(len(runs), bool)
            second[1:] = left[:-1] & ~left[1:]
            merged = np.cumsum(~second) - 1
            keep = np.flatnonzero(~second)
            paired = np.append(second[1:], False)[keep]
            following = np.minimum(keep + 1, len(runs) - 1)
            words_of = np.add.reduceat(size, head)
            # the interior loses its first and last run, and a symbol that may be paired with one outside
            low, high = run[lo] + 1, run[hi - 1]
            low = low + ~left[np.minimum(low, len(runs) - 1)]
            high = high - left[high - 1]
            stay = low < high
            settle(alive[~stay], lo[~stay], hi[~stay])
            alive, low, high = alive[stay], low[stay], high[stay]
            lo, hi = merged[low], merged[high - 1] + 1
            symbol = np.where(paired, mix(runs[keep] * np.uint64(_BASE) + mix(runs[following])), runs[keep])
            first = first[head][keep]
            size = np.where(paired, words_of[keep] + words_of[following], words_of[keep])
    settle(alive, lo, hi)
    return place, length, name


class Spans:
    """The spans of a chunk of texts: ``doc``, ``name``, ``key``, and their windows from ``low`` up to ``high``."""

    def __init__(self, texts: list[bytes], window: int, rounds: int):
        self.chunk, self.window = Chunk(texts, fold=False), window
        c = self.chunk
        words = c.word_hashes()
        with np.errstate(over="ignore"):
            power, self._undo = (np.cumprod(np.append(np.uint64(1), np.full(len(words), b, np.uint64))) for b in (_BASE, _BACK))
            self._sum = np.append(np.uint64(0), np.cumsum(words * power[:-1]))
        last = len(words) - window + 1
        self.at = np.flatnonzero(c.doc[:last] == c.doc[window - 1 :]) if last > 0 else np.empty(0, np.int64)
        if not len(self.at):
            self.low = self.high = self.doc = np.empty(0, np.int64)
            self.name = self.key = np.empty(0, np.uint64)
            return
        place, length, name = anchors(words, self.at, window, rounds)
        new = np.ones(len(self.at), bool)
        new[1:] = (np.diff(self.at) != 1) | (np.diff(place) != 0) | (np.diff(length) != 0) | (c.doc[self.at[1:]] != c.doc[self.at[:-1]])
        head = np.flatnonzero(new)
        self.low, self.high = self.at[head], self.at[np.append(head[1:], len(new)) - 1] + 1
        self.name, self.doc = name[head], c.doc[self.at[head]]
        self.key = self.fingerprint(self.low, self.high - 1 + window)

    def fingerprint(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self._sum[end] - self._sum[start]) * self._undo[start] + (end - start).astype(np.uint64))


def _lists(batch: pa.RecordBatch, column: str, fields: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A column of lists of structs of integers as arrays; ``row`` of each struct first."""
    lists = batch.column(column)
    sizes = np.array([n or 0 for n in lists.value_lengths().to_pylist()], np.int64)
    flat = lists.flatten()
    return np.repeat(np.arange(len(sizes)), sizes), {f: np.asarray(flat.field(f)) for f in fields}


def _slices(batches):
    """(rows, texts, spans' texts) in parts of bounded size: SLICE_ROWS rows or a chunk's bytes, or one text."""
    for whole in batches:
        for i in range(0, whole.num_rows, SLICE_ROWS):
            batch = whole.slice(i, SLICE_ROWS)
            k = 0
            for part in chunks(batch.column("text").cast(pa.binary()).to_pylist()):
                yield batch.slice(k, len(part)), part
                k += len(part)


def _record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) if isinstance(v, np.ndarray) else v for v in columns.values()], list(columns))


def _written(df: DataFrame, kind: str) -> DataFrame:
    folder = shared_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _all_spans(texts: DataFrame, window: int, rounds: int) -> DataFrame:
    """(d, name, key) of every distinct span of every text."""

    def run(batches):
        for batch, part in _slices(batches):
            s = Spans(part, window, rounds)
            rows = np.unique(np.stack([batch.column("d").to_numpy()[s.doc], s.name.view(np.int64), s.key.view(np.int64)], 1), axis=0)
            yield _record(d=rows[:, 0].copy(), name=rows[:, 1].copy(), key=rows[:, 2].copy())

    return arrow_map(texts, run, "d long, name long, key long")


def _windows(texts: DataFrame, looked: DataFrame, window: int, rounds: int) -> DataFrame:
    """(d, name, key, at, print): the windows of the spans ``looked`` (d, name, key) into, numbered within a span."""
    lists = looked.groupBy("d").agg(F.collect_set(F.struct("name", "key")).alias("spans"))

    def run(batches):
        for batch, part in _slices(batches):
            s = Spans(part, window, rounds)
            row, wanted = _lists(batch, "spans", ["name", "key"])
            i, _ = matches(s, row, wanted)
            size = s.high[i] - s.low[i]
            span = np.repeat(i, size)
            at = np.arange(len(span)) - np.repeat(np.cumsum(size) - size, size)
            start = s.low[span] + at
            prints = s.fingerprint(start, start + window)
            yield _record(d=batch.column("d").to_numpy()[s.doc[span]], name=s.name[span].view(np.int64), key=s.key[span].view(np.int64), at=at.astype(np.int32), print=prints.view(np.int64))

    return arrow_map(texts.join(lists, "d").select("d", "text", "spans"), run, "d long, name long, key long, at int, print long")


def matches(s: Spans, row: np.ndarray, wanted: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places: a span of a chunk, and an entry that asks for it by row, name and key."""
    own = pd.DataFrame({"row": s.doc, "name": s.name.view(np.int64), "key": s.key.view(np.int64), "i": np.arange(len(s.doc))})
    asked = pd.DataFrame({"row": row, "name": wanted["name"], "key": wanted["key"], "j": np.arange(len(row))})
    both = own.merge(asked, on=["row", "name", "key"])
    return both["i"].to_numpy(), both["j"].to_numpy()


def repeats(texts: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(d, name, key, at): spans of (d, text) whose words, or whose window ``at`` alone, an earlier text has; at is -1
    for whole spans."""
    spans = _written(_all_spans(texts, window, rounds), "spans")
    first = spans.groupBy("name", "key").agg(F.min("d").alias("rep"))
    several = first.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    met = spans.join(first.hint("merge"), ["name", "key"])
    whole = met.where("rep < d").select("d", "name", "key", F.lit(-1).alias("at"))
    looked = met.where("rep = d").join(several.hint("merge"), "name", "left_semi").select("d", "name", "key", F.lit(0).alias("at"))
    marks = _written(whole.unionByName(looked), "marks")
    windows = _written(_windows(texts, marks.where("at = 0"), window, rounds), "windows")
    least = windows.groupBy("name", "print").agg(F.min("d").alias("rep"))
    single = windows.join(least.hint("merge"), ["name", "print"]).where("rep < d").select("d", "name", "key", "at")
    return marks.where("at = -1").unionByName(single)


FIELDS = "n_words long, n_removed long, kept_sha256 string"


def substring_dedup(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: words in a window that an earlier document has as well are removed."""
    doc_id = integer_id(docs, "doc_id")
    texts = docs.select(F.coalesce(doc_id, F.lit(LAST)).alias("d"), filled().alias("text"))
    lists = repeats(texts, window, rounds).groupBy("d").agg(F.collect_list(F.struct("name", "key", "at")).alias("hits"))
    rows = docs.select(doc_id, F.coalesce(doc_id, F.lit(LAST)).alias("d"), filled().alias("text")).join(lists.hint("merge"), "d", "left")

    def run(batches):
        for batch, part in _slices(batches):
            row, hits = _lists(batch, "hits", ["name", "key", "at"])
            s = Spans(part, window, rounds) if len(row) else None
            c = s.chunk if s else Chunk(part, fold=False)
            edge = np.zeros(len(c.starts) + 1, np.int64)
            if s:
                i, j = matches(s, row, hits)
                at = hits["at"][j].astype(np.int64)
                np.add.at(edge, s.low[i] + np.maximum(at, 0), 1)
                np.add.at(edge, np.where(at < 0, s.high[i] - 1, s.low[i] + at) + window, -1)
            kept = np.cumsum(edge)[:-1] == 0
            # kept words, each with a space in place of the byte after it
            data, take = c.buf.copy(), np.zeros(len(c.buf) + 1, np.int8)
            data[c.ends] = 32
            take[c.starts[kept]] += 1
            take[c.ends[kept] + 1] -= 1
            inside = np.cumsum(take[:-1]).astype(bool)
            out, cut = data[inside].tobytes(), np.append(0, np.cumsum(inside))
            shas = [hashlib.sha256(out[a : max(a, b - 1)]).hexdigest() for a, b in zip(cut[c.begin], cut[c.end + 1], strict=True)]
            gone = np.append(0, np.cumsum(~kept))
            n_removed = gone[c.word_at + c.words] - gone[c.word_at]
            yield _record(doc_id=batch.column("doc_id"), n_words=c.words.astype(np.int64), n_removed=n_removed, kept_sha256=pa.array(shas, pa.string()))

    return arrow_map(rows.select("doc_id", "text", "hits"), run, "doc_id long, " + FIELDS)


SQL = r"""
with texts as (
  select row_number() over () as uid, doc_id, coalesce(doc_id, 9223372036854775807) as d, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), windows as (
  select uid, d, i, array_to_string(words[i : i + 49], ' ') as content from texts, range(1, len(words) - 48) as n(i)
), repeated as (
  select uid, i from windows join (select content, min(d) as least from windows group by content) using (content) where least < d
), removed as (select distinct uid, i + k as i from repeated, range(50) as n(k)),
kept as (
  select uid, string_agg(words[i], ' ' order by i) as whole from (select uid, words, unnest(range(1, len(words) + 1)) as i from texts) w
  where not exists (select 1 from removed r where r.uid = w.uid and r.i = w.i) group by uid
)
select doc_id, len(words)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(whole, '')) as kept_sha256
from texts left join (select uid, count(*) as n from removed group by uid) using (uid) left join kept using (uid)
"""
