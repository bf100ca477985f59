"""The entry without the optional subpackage: the rest still imports and lists its queries."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("cellpath/llm", "corpus_pipeline.py"), ("cellpath/llm",)])
def test_entry_without_optional_parts(tmp_path, gone):
    copy = tmp_path / "repo"
    left_out = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache")

    def ignore(folder, names):
        here = os.path.relpath(folder, ROOT)
        return left_out(folder, names) | {n for n in names if os.path.normpath(os.path.join(here, n)) in gone}

    shutil.copytree(ROOT, copy, ignore=ignore)
    code = (
        "import __spark_entry__ as e\n"
        "from cellpath.plans import catalog, oracles\n"
        "assert e.queries().keys() == catalog.queries().keys()\n"
        "assert e.oracle_sql().keys() == oracles.oracle_sql().keys()\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
