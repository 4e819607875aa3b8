"""Runnable jobs over the library: each a function of a session, a command line and a small config file."""

from __future__ import annotations

from . import conversation_rules, session_conformance


def queries():
    """The jobs as registered queries: each runs its job twice into one new folder and reads the output back."""
    return {"job1_conversation_rules": conversation_rules.query, "job2_session_conformance": session_conformance.query}


def oracle_sql():
    return {"job1_conversation_rules": conversation_rules.SQL, "job2_session_conformance": session_conformance.SQL}
