"""The code queries stand without the subpackage for corpora."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), 'pipeline' in q, any(n.startswith('op') for n in q))"


@pytest.mark.parametrize("gone", [["lodestone/llm", "tests/llm", "corpus_pipeline.py"], ["lodestone/llm", "tests/llm"]])
def test_queries_without_llm(tmp_path, gone):
    at = tmp_path / "copy"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for g in gone:
        shutil.rmtree(at / g, ignore_errors=True)
        (at / g).unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", ASK], cwd=at, env=env, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
    queries, oracles, *rest = got.stdout.split()
    assert int(queries) >= 68 and int(oracles) >= 66 and rest == ["False", "False"]
