"""Conversation structure repair: a shortest path through a role grammar, by recursive DuckDB queries.

Conversations are dealt over tasks by a hash of their id and sorted by turn.  A task hands its rows, SLICE at a time, to
DuckDB; every recursion of the query advances all conversations of the slice by one turn and keeps, for each state of
the grammar, the least cost and, of equal costs, the least audit.  The grammar is an optional system message and then
pairs of a user and an assistant message; a conversation may be empty.

States: 0 nothing yet, 1 after the system message, 2 after a user message, 3 after an assistant message; a conversation
may end in 0 and 3.  Edits are Keep (0), Rerole (1), Delete (2, the only one for blank and repeated messages) and Insert
of an empty message (5); a truncated message that isn't deleted costs 5 more.  A row's edit and the inserts after it
are one edge of a table that is made once; a state is at most two inserts from any other.

Why the least audit of a state suffices: of two audits of equal cost that end in one state after the same rows, neither
begins with the other (the rest would be inserts, which cost), so whatever follows both, their order stays.

A conversation that reaches past a slice is carried: the next slice starts from each of its states, and what is carried
is a cost, an audit and a running hash for each state.  So no task holds a conversation, however long; its audit and its
hash are each one value that must be made in order, so one task reads its rows once, in order, from Spark's sort.
Messages seen earlier of a carried conversation are kept as digests in the task's DuckDB, which may spill.

Defined cases: a null role or text, and a null id or turn in the text that is hashed for damage, counts as one space; a
null turn sorts first; rows with a null conv_id are one conversation, with a null conv_id; rows of one turn are
ordered by role and text; a conversation whose rows are all dropped has zeros, an empty audit and the hash of the empty
string; texts of any length are read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import shutil
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, integer_id

#: Rows of one recursive query.
SLICE = 4096
#: Edges of the grammar: (state, role initial it takes, next state).
STEPS = [(0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2)]
NAMES = {"u": "user", "a": "assistant"}
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED, FINAL = 5, (0, 3)
SPACES = " \t\n\x0b\x0c\r"

SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows with drawn faults.  A dropped row has 0 copies and no text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    ids = conversations.select(integer_id(conversations, "conv_id"), integer_id(conversations, "turn"), space("role").alias("role"), space("text").alias("text"))
    fault = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    rows = ids.withColumn("fault", fault)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    gone = F.col("fault") == 0
    return rows.select(
        "conv_id", "turn", F.when(~gone, role).alias("role"), F.when(~gone, text).alias("text"),
        F.when(gone, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("copies"),
    )


def _observed(rows: DataFrame) -> DataFrame:
    """Adds what the grammar needs to know of a message: whether it is blank or cut off, and a digest of role and text."""
    end: Column = F.rtrim(F.col("text"), F.lit(SPACES))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.select("*", (end == "").alias("empty"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"), digest.alias("digest"))


def _inserts(state: int) -> Iterator[tuple[int, int, str]]:
    """(state, cost, letters) reachable by no, one or two inserts."""
    yield state, 0, ""
    cost, letters = 0, ""
    for _ in range(2):
        state = next(t for s, i, t in STEPS if s == state and i in NAMES)
        cost, letters = cost + COST["I"], letters + "I"
        yield state, cost, letters


def edges() -> list[tuple]:
    """(kind, source, target, cost, letters): the best edit of one row with the inserts after it.

    A kind is a role initial (x: any other) and whether the row must go (d), is truncated (t) or is sound (c)."""
    best: dict[tuple, tuple] = {}
    for initial in "suax":
        for flag in "dtc":
            for source in range(4):
                moves = [("D", source, COST["D"])]
                if flag != "d":
                    more = TRUNCATED if flag == "t" else 0
                    moves += [("K", t, COST["K"] + more) for s, i, t in STEPS if s == source and i == initial]
                    moves += [("R", t, COST["R"] + more) for s, i, t in STEPS if s == source and i in NAMES]
                for letter, state, cost in moves:
                    for target, extra, letters in _inserts(state):
                        key, value = (initial + flag, source, target), (cost + extra, letter + letters)
                        best[key] = min(best.get(key, value), value)
    return [(*k, *v) for k, v in sorted(best.items())]


FACTS = """create or replace temp table facts as
select i, conv, pos, turn, initial, empty, again, cut and not empty and not again as truncated,
  initial || case when empty or again then 'd' when cut then 't' else 'c' end as kind
from (
  select i, conv, turn, case when initial in ('s', 'u', 'a') then initial else 'x' end as initial, empty, cut, row_number() over (partition by conv order by i) as pos,
    not empty and (row_number() over (partition by conv, r.digest order by i) > 1 or (conv = 0 and s.digest is not null)) as again
  from rows r left join seen s on s.digest = r.digest
)
"""
SUMS = """
select conv, count(*) as n, min(turn) as low, max(turn) as high, count(distinct turn) as turns, count(*) filter (empty) as blank, count(*) filter (again) as duplicate,
  count(*) filter (truncated) as truncated, count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal,
  arg_min(initial, pos) as first, arg_max(initial, pos) as last
from (select *, lag(initial) over (partition by conv order by pos) as before from facts) group by conv order by conv
"""
#: Each recursion takes every conversation one row on.
REPAIR = """
with recursive step(conv, origin, pos, state, best) as (
  select conv, origin, 0::bigint, state, {'cost': cost, 'audit': audit} from start
  union all
  select s.conv, s.origin, s.pos + 1, e.target, min({'cost': s.best.cost + e.cost, 'audit': s.best.audit || e.letters})
  from step s join facts f on f.conv = s.conv and f.pos = s.pos + 1 join edges e on e.kind = f.kind and e.source = s.state
  group by s.conv, s.origin, s.pos, e.target
)
select step.conv, origin, state, best.cost, best.audit from step join (select conv, max(pos) as n from facts group by conv) l on l.conv = step.conv and pos = n
order by 1, 2, 3
"""


class Open:
    """A conversation that may go on: for each state its cost, audit and running hash; and its counts so far."""

    def __init__(self, conv_id):
        self.conv_id, self.low, self.high, self.turns, self.last = conv_id, None, None, 0, None
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.states = {0: (0, "", hashlib.sha256())}
        self.fresh = True

    def add(self, sums: dict) -> None:
        for c in self.counts:
            self.counts[c] += sums[c]
        if self.last is not None and self.last + sums["first"] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        if sums["low"] is not None:
            self.turns += sums["turns"] - (self.high == sums["low"])
            self.low, self.high = sums["low"] if self.low is None else self.low, sums["high"]
        self.last = sums["last"]

    def advance(self, found: list[tuple], texts: list[tuple[str, str]], wanted) -> None:
        """Takes the states on; ``found``: (origin, state, cost, audit), ``texts``: the (role, text) of the rows."""
        best: dict[int, tuple] = {}
        for origin, state, cost, audit in found:
            before = self.states[origin]
            key = (before[0] + cost, before[1] + audit, origin, audit)
            if state in wanted and (state not in best or key[:2] < best[state][:2]):
                best[state] = key
        if wanted is FINAL and best:
            state = min(best, key=lambda s: best[s][:2])
            best = {state: best[state]}
        after = {}
        for state, (cost, audit, origin, letters) in best.items():
            h = self.states[origin][2].copy()
            _replay(h, letters, texts, origin, self.states[origin][1].strip("D") != "")
            after[state] = (cost, audit, h)
        self.states, self.fresh = after, False

    def row(self) -> tuple:
        cost, audit, h = min((v for s, v in self.states.items() if s in FINAL), key=lambda v: v[:2])
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)
        return (self.conv_id, gaps, *self.counts.values(), cost, audit, h.hexdigest())


def _replay(h, letters: str, texts: list[tuple[str, str]], state: int, begun: bool) -> None:
    """Adds the repaired messages to a hash, joined by newlines."""
    i = 0
    for letter in letters:
        role, text = ("", "") if letter == "I" else texts[i]
        i += letter != "I"
        if letter == "D":
            continue
        if letter == "K":
            state = next(t for s, n, t in STEPS if s == state and role[:1] == n)
        else:
            initial, state = next((n, t) for s, n, t in STEPS if s == state and n in NAMES)
            role = NAMES[initial]
        h.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
        begun = True


class Repairer:
    """Repairs the sorted rows of one task, slice by slice."""

    def __init__(self):
        self.spill = tempfile.mkdtemp(prefix="repair-")
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": self.spill})
        columns = zip(*edges(), strict=True)
        self.con.register("e", pa.table({n: list(c) for n, c in zip(("kind", "source", "target", "cost", "letters"), columns, strict=True)}))
        self.con.execute("create table edges as select * from e")
        self._forget()
        self.open: Open | None = None

    def _forget(self):
        self.con.execute("create or replace table seen(digest blob)")

    def close(self):
        self.con.close()
        shutil.rmtree(self.spill, ignore_errors=True)

    def slice(self, batch: pa.RecordBatch) -> list[tuple]:
        """The results of all conversations that are known to have ended."""
        out = []
        ids = batch.column("conv_id").to_pylist()
        copies = batch.column("copies").to_numpy()
        heads = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
        if self.open is not None and self.open.conv_id != ids[0]:
            out.append(self.open.row())
            self.open = None
        if self.open is None:
            self._forget()
        convs = [self.open or Open(ids[0])] + [Open(ids[i]) for i in heads[1:]]
        conv = np.repeat(np.arange(len(heads)), np.diff([*heads, len(ids)]))
        at = np.repeat(np.arange(len(ids)), copies)
        roles, texts = (batch.column(c).take(pa.array(at)) for c in ("role", "text"))
        told = list(zip(roles.to_pylist(), texts.to_pylist(), strict=True))
        self.con.register("rows", pa.table({
            "i": np.arange(len(at)), "conv": conv[at], "initial": pa.array([r[:1] for r, _ in told], pa.string()),
            **{c: batch.column(c).take(pa.array(at)) for c in ("turn", "empty", "cut", "digest")},
        }))
        self.con.execute(FACTS)
        starts = [(k, o, *s) for k, c in enumerate(convs) for o in c.states for s in (_inserts(0) if c.fresh else [(o, 0, "")])]
        self.con.register("start", pa.table({n: list(c) for n, c in zip(("conv", "origin", "state", "cost", "audit"), zip(*starts, strict=True), strict=True)}))
        sums = self.con.sql(SUMS).to_arrow_table().to_pylist()
        found = self.con.sql(REPAIR).fetchall()
        row = {s["conv"]: s for s in sums}
        cut = np.searchsorted(conv[at], np.arange(len(convs) + 1))
        ways: dict[int, list] = {}
        for k, *way in found:
            ways.setdefault(k, []).append(way)
        for k, c in enumerate(convs):
            last = k == len(convs) - 1
            if k in row:
                c.add(row[k])
                c.advance(ways[k], told[cut[k] : cut[k + 1]], range(4) if last else FINAL)
            if not last:
                out.append(c.row())
        if len(convs) > 1:
            self._forget()
        self.con.execute(f"insert into seen select distinct digest from rows where conv = {len(convs) - 1} except select digest from seen")
        self.open = convs[-1]
        return out

    def finish(self) -> list[tuple]:
        return [self.open.row()] if self.open is not None else []


def _names() -> list[str]:
    return [f.split()[0] for f in SCHEMA.split(", ")]


def repair(rows: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """Per conversation of (conv_id, turn, role, text, copies): its faults, and the cheapest repair."""
    dealt = _observed(rows).repartition("conv_id").sortWithinPartitions(*[F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")])

    def run(batches):
        names = _names()
        types = [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in names]
        give = lambda some: pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], t) for i, t in enumerate(types)], names)
        repairer = Repairer()
        try:
            for whole in batches:
                for i in range(0, whole.num_rows, slice_rows):
                    if some := repairer.slice(whole.slice(i, slice_rows)):
                        yield give(some)
            yield give(repairer.finish())
        finally:
            repairer.close()

    return arrow_map(dealt, run, SCHEMA)


def conversation_repair(conversations: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """Damages the conversations by a draw for each row and repairs them; one row for every conv_id."""
    return repair(damaged(conversations), slice_rows)


SQL = r"""
with recursive bits as (
  select list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by b) as t
  from (select unnest(range(256)) as b)
), drawn as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda s: ascii(s)::bigint)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 as fault
  from conversations, bits
), broken as (
  select coalesce(conv_id::varchar, '') as conv, turn, case when fault = 4 then 'user' else role end as role,
    case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from drawn, range(case fault when 0 then 0 when 3 then 2 else 1 end) as n(copy)
), placed as (
  select *, left(role, 1) as initial, row_number() over (partition by conv order by turn nulls first, role, text) as pos from broken
), judged as (
  select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, row_number() over (partition by conv, role, text order by pos) > 1 as again,
    not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') as cut, lag(initial) over (partition by conv order by pos) as before
  from placed
), facts as (
  select *, again and not blank as duplicate, cut and not blank and not again as truncated,
    before is not null and before || initial not in ('su', 'ua', 'au') as illegal from judged
), arcs(source, initial, target) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(source, target, cost, letters) as (
  values (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (2, 3, 5, 'I'), (3, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II'), (3, 3, 10, 'II'), (2, 2, 10, 'II')
), moves as (
  select conv, pos, s as source, s as target, 2 as cost, 'D' as letter from facts, range(4) as n(s)
  union all select conv, pos, source, target, case when cut then 5 else 0 end, 'K' from facts join arcs using (initial) where not blank and not again
  union all select conv, pos, source, target, case when cut then 6 else 1 end, 'R' from facts, arcs where arcs.initial <> 's' and not blank and not again
), step as (
  select distinct coalesce(conv_id::varchar, '') as conv, 0::bigint as pos, ins.target as state, {'cost': ins.cost, 'audit': ins.letters} as best from conversations, ins where ins.source = 0
  union all
  select s.conv, s.pos + 1, i.target, min({'cost': s.best.cost + m.cost + i.cost, 'audit': s.best.audit || m.letter || i.letters})
  from step s join moves m on m.conv = s.conv and m.pos = s.pos + 1 and m.source = s.state join ins i on i.source = m.target
  group by s.conv, s.pos, i.target
), cheapest as (
  select conv, min(best) as best from step where state in (0, 3) and pos = coalesce((select max(f.pos) from facts f where f.conv = step.conv), 0) group by conv
), letters as (
  select conv, k, best.audit[k] as letter from cheapest, range(1, length(best.audit) + 1) as n(k)
), spots as (
  select conv, k, letter, sum(case when letter = 'I' then 0 else 1 end) over (partition by conv order by k) as pos,
    sum(case when letter = 'D' then 0 else 1 end) over (partition by conv order by k) as place from letters
), kept as (
  select s.conv, s.place, s.letter, f.role, coalesce(case when s.letter <> 'I' then f.text end, '') as text,
    max(case when s.place = 1 and s.letter = 'K' and f.initial = 's' then 1 else 0 end) over (partition by s.conv) as system
  from spots s left join facts f on f.conv = s.conv and f.pos = s.pos where s.letter <> 'D'
), repaired as (
  select conv, string_agg(case when letter = 'K' then role when (place - system) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by place) as whole from kept group by conv
), counts as (
  select conv, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
    count(*) filter (illegal) as illegal from facts group by conv
)
select c.conv_id, coalesce(n.gaps, 0) as gaps, coalesce(n.blank, 0) as blank, coalesce(n.duplicate, 0) as duplicate, coalesce(n.truncated, 0) as truncated, coalesce(n.illegal, 0) as illegal,
  best.cost::bigint as cost, best.audit as audit, sha256(coalesce(whole, '')) as repaired_sha256
from (select distinct conv_id, coalesce(conv_id::varchar, '') as conv from conversations) c join cheapest using (conv) left join counts n using (conv) left join repaired using (conv)
"""
