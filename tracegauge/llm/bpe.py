"""Byte-level BPE encoding and decoding with DuckDB recursive queries in each partition.

Texts are split by the vocabulary's pattern.  A piece that is a token of its own is looked up; the distinct
other pieces become rows of tokens by position, and a recursive query joins adjacent tokens with the merge
table and contracts, in every round, each word's leftmost pairs of minimum rank, until no pair is in the
table.  Ordered aggregation gives a piece's ids, and, by the table of token bytes, a document's bytes back.

Every piece goes the same way, however long.  The minimum is taken over stretches of 1 << STRETCH bytes and their
neighbours on both sides, which is the whole word unless it is longer; so far-off parts of a long word are contracted
in one round.  Of equal pairs that overlap, the first, third and so on are contracted.  The result is that of one
leftmost pair at a time, as no token spans a stretch and as a merge only makes pairs of higher rank; both are checked
when a vocabulary is read, and one that breaks them is refused.  A query makes as many rounds as keep its rows under
ROWS; words that aren't finished then go into the next one.

Ids of short pieces are remembered by the Python worker, up to MEMORY bytes.  DuckDB may spill into the worker's own
temporary folder, as Spark does; nobody else reads from there.

Defined cases: a null text is empty; an empty text has no ids and decodes to no bytes; repeated rows are
encoded each; of equal pairs the left one goes first; texts and pieces of any length are encoded whole; an empty
table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textkit import add_columns
from .token_counts import read_ranks

#: Bytes of a stretch, as a power of two, twice the longest token at least; bits of a position in a piece.
STRETCH, PLACE = 8, 40
#: Pieces in one recursive query; its rows, of all rounds; bytes of texts that are encoded together, and of ids that
#: are decoded by one query.
PIECES, ROWS, ENCODE_BYTES, DECODE_BYTES = 30_000, 1_000_000, 4 << 20, 1 << 20
#: Bytes of remembered pieces, and the longest of them.
MEMORY, REMEMBERED = 128 << 20, 32


def merge_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, bool]:
    """(pair key, rank) of every pair of tokens whose bytes together are a token; whether ranks only rise.

    They rise if no merge can leave a pair of lower rank.  A pair whose own rank is below that of one of its
    tokens would be such a pair; it never comes up if its bytes, taken alone, become one token by merges of
    at most its rank, as these all come before the merge that makes the later token.
    """
    keys, merged, doubtful = [], [], set()
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                keys.append(a << 32 | b)
                merged.append(rank)
                if (i > 1 and a > rank) or (i < len(token) - 1 and b > rank):
                    doubtful.add(token)
    rising = all(_becomes_one(t, ranks) for t in doubtful)
    return np.array(keys, np.int64), np.array(merged, np.int64), rising


def _becomes_one(token: bytes, ranks: dict[bytes, int]) -> bool:
    parts, most = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, most + 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank > most:
            return False
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return True


#: id: piece << PLACE | position.  Each row knows its right neighbour (after, next) and the rank of their pair, so that
#: a round needs no sort and looks up only pairs that are new.
CONTRACT = f"""create or replace temp table state as
with recursive step(id, after, token, next, rank, round) as (
  select id, after, token, next, rank, 0 from todo
  union all (
    with ranked as materialized (
      select * from step where rank is not null and round < {{rounds}}
    ), lowest as materialized (
      select id >> {STRETCH} as block, min(rank) as low from ranked group by 1
    ), near as (
      select block, min(low) as low from (
        select block, low from lowest
        union all select block + d, low from lowest join wide on piece = block >> {PLACE - STRETCH}, (values (-1), (1)) as n(d)
      ) group by 1
    ), low as materialized (
      select r.id, r.after, r.rank from near join ranked r on r.id >> {STRETCH} = near.block and r.rank = near.low
    ), overlap as materialized (
      select l.id as one, n.id as two from low l join low n on n.id = l.after
    ), runs as materialized (
      select id, i - max(case when starts then i end) over (order by i) as place from (
        select id, id not in (select two from overlap) as starts, row_number() over (order by id) as i
        from (select one as id from overlap union select two from overlap)
      )
    ), hit as materialized (
      select l.id, l.after as gone, l.rank as merged from low l left join runs on runs.id = l.id where place is null or place % 2 = 0
    ), made as materialized (
      select h.id, h.gone, h.merged, b.after, coalesce(x.merged, b.next) as next
      from hit h join step b on b.id = h.gone left join hit x on x.id = b.after
    ), active as (select distinct id >> {PLACE} as piece from hit),
    moved as materialized (
      select r.id, case when f.id is null then r.after else f.after end as after, coalesce(f.merged, r.token) as token,
        case when f.id is null then coalesce(x.merged, r.next) else f.next end as next, r.rank, f.id is not null or x.id is not null as new, r.round + 1 as round
      from step r join active on active.piece = r.id >> {PLACE} left join made f on f.id = r.id left join made x on x.id = r.after
      where not exists (select 1 from made g where g.gone = r.id)
    ), pairs as (
      select m.key, m.rank from merges m join (select distinct token << 32 | next as key from moved where new) k on m.key = k.key
    )
    select id, after, moved.token, moved.next, case when new then p.rank else moved.rank end, round
    from moved left join pairs p on p.key = case when new then (moved.token << 32 | moved.next) end
  )
)
select id, after, token, next, rank, last from (select id >> {PLACE} as piece, max(round) as last from step group by 1) join step on piece = id >> {PLACE} and round = last
"""


class Codec:
    """Encodes pieces and decodes ids in an in-memory DuckDB of one thread and bounded memory."""

    def __init__(self, ranks: dict[bytes, int], merges: tuple, pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        keys, merged, rising = merges
        if not rising or 2 * max(map(len, ranks)) > 1 << STRETCH:
            raise ValueError("not a vocabulary that stretches of a word can be contracted by")
        self.spill = tempfile.mkdtemp(prefix="bpe-")
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": self.spill})
        self.con.register("m", pa.table({"key": keys, "rank": merged}))
        self.con.execute("create table merges as select * from m")
        self.con.register("v", pa.table({"id": pa.array(list(ranks.values()), pa.int64()), "bytes": pa.array(list(ranks), pa.binary())}))
        self.con.execute("create table vocabulary as select * from v")
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        self.known: dict[str, bytes] = {}
        self.held = 0
        atexit.register(self.close)

    def close(self):
        self.con.close()
        shutil.rmtree(self.spill, ignore_errors=True)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        for k in range(0, len(pieces), PIECES):
            some = pieces[k : k + PIECES]
            sizes = np.array([len(p) for p in some], np.int64)
            tokens, last = self.single[np.frombuffer(b"".join(some), np.uint8)], np.cumsum(sizes) - 1
            pos = np.arange(len(tokens)) - np.repeat(last + 1 - sizes, sizes)
            ids, ends = np.repeat(np.arange(len(some)), sizes) << PLACE | pos, np.zeros(len(tokens), bool)
            ends[last] = True
            self.con.register("begin", pa.table({"id": ids, "after": pa.array(ids + 1, mask=ends), "token": tokens, "next": pa.array(np.append(tokens[1:], 0), mask=ends)}))
            self.con.execute("create or replace table todo as select b.*, rank from begin b left join merges on key = (token << 32 | next)")
            self.con.execute(f"create or replace table wide as select distinct id >> {PLACE} as piece from todo where id & {(1 << PLACE) - 1} >= {1 << STRETCH}")
            rows = len(tokens)
            while rows:
                rounds = max(1, ROWS // rows)
                self.con.execute(CONTRACT.format(rounds=rounds))
                got = self.con.sql(f"select id >> {PLACE} as piece, list(token order by id) as ids from state where last < {rounds} group by 1").to_arrow_table().combine_chunks()
                if len(got):
                    lists = got["ids"].combine_chunks()
                    cut, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
                    for i, a, b in zip(got["piece"].to_pylist(), cut, cut[1:], strict=False):
                        out[k + i] = flat[a:b].tobytes()
                self.con.execute(f"create or replace table todo as select id, after, token, next, rank from state where last = {rounds}")
                rows = self.con.execute("select count(*) from todo").fetchall()[0][0]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.pattern.findall(t) for t in texts]
        known, own = self.known, {}
        for p in set().union(*split):
            if p not in known:
                raw = p.encode()
                own[p] = np.array([r], "<u4").tobytes() if (r := self.ranks.get(raw)) is not None else None
        missing = [p for p, ids in own.items() if ids is None]
        own.update(zip(missing, self.encode_pieces([p.encode() for p in missing]), strict=True))
        out = [b"".join([known.get(p) or own[p] for p in s]) for s in split]
        for p, ids in own.items():
            if self.held >= MEMORY:
                break
            if len(p) <= REMEMBERED:  # 200: two objects and their place in the dictionary
                known[p] = ids
                self.held += 4 * len(p) + len(ids) + 200
        return out

    def decode(self, ids: list[bytes]) -> Iterator[memoryview]:
        """The bytes of each document."""
        i = 0
        while i < len(ids):
            j, size = i, 0
            while j < len(ids) and (j == i or size + len(ids[j]) <= DECODE_BYTES):
                size += len(ids[j])
                j += 1
            yield from self._decode(ids[i:j])
            i = j

    def _decode(self, ids: list[bytes]) -> list[memoryview]:
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        self.con.register("tokens", pa.table({"doc": np.repeat(np.arange(len(ids)), sizes), "pos": np.arange(len(flat)), "id": flat}))
        got = self.con.sql(
            "select doc, list(bytes order by pos) as bytes from tokens join vocabulary using (id) group by doc order by doc"
        ).to_arrow_table()
        out = [memoryview(b"")] * len(ids)
        for chunk in got.to_batches():
            lists = chunk.column("bytes")
            values = lists.values
            at = np.frombuffer(values.buffers()[1], np.int64 if pa.types.is_large_binary(values.type) else np.int32)[values.offset :]
            data = memoryview(values.buffers()[2])
            cut = at[lists.offsets.to_numpy()]
            for doc, a, b in zip(chunk.column("doc").to_pylist(), cut, cut[1:], strict=False):
                out[doc] = data[a:b]
        return out


_codecs: dict[str, Codec] = {}


def worker_codec(name: str, shared: Broadcast) -> Codec:
    """This worker's codec, with the pieces that it knows from earlier tasks.

    A function of the module, as one made inside another is sent with a copy of the globals that it names.
    """
    if name not in _codecs:
        _codecs[name] = Codec(*shared.value)
    return _codecs[name]


FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    ranks = read_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, merge_table(ranks), pattern))  # of fixed size
    name = f"{vocabulary}|{pattern}"

    def kernel():
        codec = worker_codec(name, shared)

        def run(texts: list[bytes]) -> dict:
            n, hashes, decoded, i = [], [], [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= ENCODE_BYTES):
                    size += len(texts[j])
                    j += 1
                ids = codec.encode([t.decode() for t in texts[i:j]])
                n += [len(x) // 4 for x in ids]
                hashes += [hashlib.sha256(x).hexdigest() for x in ids]
                decoded += [hashlib.sha256(x).hexdigest() for x in codec.decode(ids)]
                i = j
            return {"n_tokens": n, "ids_sha256": hashes, "decoded_sha256": decoded}

        return run

    return add_columns(docs, kernel, FIELDS, ["doc_id"])
