"""The jobs: against their SQL, by two runs over growing input, after a crash, and from the command line."""

import datetime as dt
import json
import logging
import os
import subprocess
import sys

import duckdb
import pytest

import jobs
from jobs import conversation_rules, session_conformance

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _clean(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(r[i], 9) + 0.0 if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


def _sql(text, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"create view {name} as select * from '{path}'")
    got = con.execute(text)
    return _clean([d[0] for d in got.description], got.fetchall())


@pytest.mark.parametrize("name", sorted(jobs.queries()))
def test_job_matches_sql(spark, name):
    df = jobs.queries()[name](spark, SF)
    tables = {t: f"{SF}/{t}.parquet" for t in ("conversations", "events")}
    assert _clean(df.columns, df.collect()) == _sql(jobs.oracle_sql()[name], **tables)


# ---- conversation rules --------------------------------------------------------------------------------


def _snapshot(folder):
    """Every data file's rows by its folder."""
    con = duckdb.connect()
    return {t: sorted(map(repr, con.execute(f"select * from read_parquet('{folder}/{t}/*/*.parquet', hive_partitioning = true)").fetchall())) for t in ("cases", "rules")}


def test_rules_rerun_and_files(spark, tmp_path, caplog):
    out = str(tmp_path / "out")
    with caplog.at_level(logging.INFO, "jobs.conversation_rules"):
        conversation_rules.run(spark, f"{SF}/conversations.parquet", out)
    assert "read" in caplog.text and "wrote" in caplog.text
    first = _snapshot(out)
    stale = tmp_path / "out" / "rules" / "family=Stale"
    stale.mkdir()
    conversation_rules.run(spark, f"{SF}/conversations.parquet", out)
    assert _snapshot(out) == first and not stale.exists()
    assert {p.name for p in (tmp_path / "out" / "cases").iterdir() if p.is_dir()} == {"outcome=0", "outcome=1"}
    lines = spark.read.text(f"{out}/negative.decl").collect()
    assert any(r[0].startswith("activity user:") for r in lines) and any("[" in r[0] for r in lines)


def test_rules_of_odd_rows(spark, tmp_path):
    rows = [(None, 0, "user", "x"), (1, None, "user", None), (1, 0, None, "a b"), (1, 0, "assistant", "w " * 40), (1, 0, "assistant", "w " * 40), (2, 0, "system", "s"), (2, 1, "user", ""), (3, 0, "system", "s")]
    path = str(tmp_path / "c.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' as trace", "1 as outcome").write.parquet(path)
    got = conversation_rules.run(spark, path, str(tmp_path / "out"))
    cases = {r["case_id"]: (r["outcome"], r["trace"]) for r in spark.read.parquet(str(tmp_path / "out" / "cases")).collect()}
    assert cases == {"1": (0, ["user:short", ":short", "assistant:long", "assistant:long"]), "2": (1, ["user:short"])}
    assert got.count() > 0


def test_rules_of_empty_table(spark, tmp_path):
    path = str(tmp_path / "c.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(path)
    assert conversation_rules.run(spark, path, str(tmp_path / "out")).count() == 0


def test_rules_command_line(tmp_path):
    config = conversation_rules.read_config() | {"permutations": 20}
    (tmp_path / "config.json").write_text(json.dumps(config))
    done = subprocess.run(
        [sys.executable, "-m", "jobs.conversation_rules", "--conversations", f"{SF}/conversations.parquet", "--out", str(tmp_path / "out"), "--config", str(tmp_path / "config.json")],
        capture_output=True, text=True, cwd=REPO, timeout=300)
    assert done.returncode == 0, done.stderr
    assert "rules" in done.stderr and _snapshot(tmp_path / "out")["rules"]


# ---- session conformance -------------------------------------------------------------------------------


def _parts(spark, folder):
    """The events of the table in two files of equal length of time, as functions that add them to a folder."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    cut = dt.datetime(2024, 1, 16)
    return [lambda: events.where(events["ts"] < cut).coalesce(1).write.mode("append").parquet(folder), lambda: events.where(events["ts"] >= cut).coalesce(1).write.mode("append").parquet(folder)]


def _expected():
    return _sql(session_conformance.SQL, events=f"{SF}/events.parquet")


def _rows(df):
    return _clean(df.columns, df.collect())


def test_sessions_of_growing_input(spark, tmp_path, caplog):
    events, out, progress = (str(tmp_path / x) for x in ("events", "out", "progress"))
    first, second = _parts(spark, events)
    first()
    with caplog.at_level(logging.INFO, "jobs.session_conformance"):
        early = _rows(session_conformance.run(spark, events, out, progress))
        second()
        both = _rows(session_conformance.run(spark, events, out, progress))
        again = _rows(session_conformance.run(spark, events, out, progress))
    counts = [int(r.message.split()[1]) for r in caplog.records if r.message.endswith("new events")]
    assert sum(counts) == 1000 and 0 < counts[0] < 1000 and counts[2] == 0
    assert 0 < len(early) < len(both) and again == both == _expected()


def test_sessions_after_crash(spark, tmp_path, monkeypatch):
    events, out, progress = (str(tmp_path / x) for x in ("events", "out", "progress"))
    first, second = _parts(spark, events)
    first()
    second()
    whole, failed = session_conformance.daily_counts, []

    def fail_once(*args):
        if not failed:
            failed.append(True)
            raise RuntimeError("lost")
        return whole(*args)

    # the first run is lost between its two writes: the sessions of its batch are there, their counts are not
    monkeypatch.setattr(session_conformance, "daily_counts", fail_once)
    with pytest.raises(Exception, match="lost"):
        session_conformance.run(spark, events, out, progress)
    assert os.path.isdir(f"{out}/sessions") and not os.path.isdir(f"{out}/daily")
    assert _rows(session_conformance.run(spark, events, out, progress)) == _expected()
    cases = spark.read.parquet(f"{out}/sessions")
    assert cases.count() == cases.select("case_id").distinct().count()


def test_sessions_command_line(tmp_path):
    done = subprocess.run(
        [sys.executable, "-m", "jobs.session_conformance", "--events", f"{SF}/events.parquet*", "--out", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "progress")],
        capture_output=True, text=True, cwd=REPO, timeout=300)
    assert done.returncode == 0, done.stderr
    assert "new events" in done.stderr and (tmp_path / "out" / "daily").is_dir()
