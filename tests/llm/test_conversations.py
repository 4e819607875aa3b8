"""Conversation repair against its SQL, and the repair of small conversations against all edit sequences."""

import hashlib
import itertools
import random

import duckdb
import pytest

from tracegauge.llm import conversations

FIELDS = "conv_id long, turn long, role string, text string"
TEXTS = ["So it is.", "Yes!", "no end", "", " \t\n", "Why? ", None, "A. b", "dot. ", "x" * 1_200_000 + "."]
ROLES = ["user", "assistant", "system", None, "", "tool", "u", "Assistant"]


def _rows(seed):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(60)]:
        size = 40 if conv in (None, 3) else r.randrange(1, 9)
        for turn in range(size):
            rows.append((conv, r.choice([turn, turn, turn, None, turn + 3]), r.choice(ROLES if r.random() < 0.3 else ROLES[:2]), r.choice(TEXTS if turn == 5 else TEXTS[:-1])))
    return rows + rows[:20]


def _sorted(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def _expected(df):
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    return _sorted(con.execute(conversations.SQL).fetchall())


@pytest.mark.parametrize("slice_rows", [4096, 5, 1])
def test_against_sql(spark, slice_rows):
    df = spark.createDataFrame(_rows(1), FIELDS).selectExpr("*", "'x' as audit", "1 as copies", "turn as pos")
    assert _sorted(tuple(r) for r in conversations.conversation_repair(df, slice_rows).collect()) == _expected(df)


def test_empty_table(spark):
    out = conversations.conversation_repair(spark.createDataFrame([], FIELDS))
    assert out.count() == 0 and out.columns == [f.split()[0] for f in conversations.SCHEMA.split(", ")]


def test_dropped_conversation(spark):
    import zlib

    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = conversations.conversation_repair(spark.createDataFrame([(lost, 0, "user", "Hi.")], FIELDS)).collect()
    assert [tuple(r) for r in row] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def _all_repairs(rows):
    """The least (cost, audit) over all sequences of at most len(rows) + 3 edits, by trying them."""
    seen, best = set(), None
    for letters in itertools.chain.from_iterable(itertools.product("DIKR", repeat=n) for n in range(len(rows), len(rows) + 4)):
        if sum(x != "I" for x in letters) != len(rows):
            continue
        cost, state, i = 0, 0, 0
        for x in letters:
            role, text = rows[i] if x != "I" else ("", "")
            blank = not text.strip(conversations.SPACES)
            bad = x != "I" and (blank or (role, text) in rows[:i])
            cut = x != "I" and not bad and text.rstrip(conversations.SPACES)[-1:] not in tuple(".!?")
            i += x != "I"
            if x == "D":
                cost += 2
                continue
            if bad:
                break
            cost += {"K": 0, "R": 1, "I": 5}[x] + (5 if cut else 0)
            initial = role[:1] if x == "K" else ("a" if state == 2 else "u")
            state = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, initial))
            if state is None:
                break
        else:
            if state in (0, 3) and (best is None or (cost, "".join(letters)) < best):
                best = (cost, "".join(letters))
        seen.add(letters)
    return best


def test_against_all_edits(spark):
    r = random.Random(7)
    convs = {c: [(r.choice(ROLES[:3] + ["tool"]), r.choice(["One.", "Two!", "three", " "])) for _ in range(r.randrange(1, 5))] for c in range(60)}
    rows = spark.createDataFrame([(c, t, role, text, 1) for c, some in convs.items() for t, (role, text) in enumerate(some)], FIELDS + ", copies int")
    got = {x["conv_id"]: (x["cost"], x["audit"]) for x in conversations.repair(rows).collect()}
    assert got == {c: _all_repairs(some) for c, some in convs.items()}
