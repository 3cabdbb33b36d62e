"""The entry file without the optional folder, and with it but without a library it needs."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def count(hidden: str) -> subprocess.CompletedProcess:
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); sys.modules[{hidden!r}] = None; import __spark_entry__ as e; print(sum(q[:2] == 'op' for q in e.queries()), len(e.queries()))"
    return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("hidden", ["corpus_pipeline", "tidemark.llm"])
def test_other_queries_stay_without_the_optional_part(hidden):
    out = count(hidden)
    assert out.returncode == 0, out.stderr
    operators, queries = map(int, out.stdout.split())
    assert operators == 0 and queries >= 150


@pytest.mark.skipif(not (ROOT / "tidemark" / "llm").exists(), reason="optional part not there")
def test_a_missing_library_is_an_error():
    out = count("zstandard")
    assert out.returncode != 0 and "zstandard" in out.stderr
