"""The driver's contract, before there is a session."""

import subprocess
import sys
from pathlib import Path


def test_import_needs_no_session():
    root = Path(__file__).resolve().parent.parent
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 70; print('fine')"], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.stdout.strip() == "fine", said.stderr
