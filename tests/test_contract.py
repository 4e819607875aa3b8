"""The contract module without parts that may be absent."""

import subprocess
import sys

import pytest

_PROBE = """
import sys
for name in {missing!r}:
    sys.modules[name] = None
import __spark_entry__ as e
names = set(e.queries())
assert set(e.oracle_sql()) <= names and "prevalence_user_days" in names
assert not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
"""


@pytest.mark.parametrize("missing", [("tracegauge.llm",), ("corpus_pipeline",), ("public_tokenizers",), ("tiktoken", "regex"), ("tokenizers",)])
def test_entry_without_optional_parts(missing):
    done = subprocess.run([sys.executable, "-c", _PROBE.format(missing=missing)], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert done.returncode == 0, done.stderr
