"""The driver's entry lists its queries before any session exists."""

import subprocess
import sys
from pathlib import Path


def test_queries_are_listed_without_a_session():
    root = Path(__file__).resolve().parent.parent
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[-1]) > 80
