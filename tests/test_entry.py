"""The entry point and the rest of the library without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_without_the_subpackage(tmp_path):
    repo = tmp_path / "repo"
    shutil.copytree(ROOT, repo, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    say = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    run = lambda: subprocess.run([sys.executable, "-B", "-c", say], cwd=repo, env=os.environ | {"PYTHONPATH": str(repo)}, capture_output=True, text=True, check=True).stdout.split()
    whole = run() if (repo / "corvane/llm").exists() else None
    shutil.rmtree(repo / "corvane/llm", ignore_errors=True)
    shutil.rmtree(repo / "tests/llm", ignore_errors=True)
    rest = run()
    assert int(rest[0]) > 50 and rest[1:] == ["False", "True"]
    (repo / "corpus_pipeline.py").unlink(missing_ok=True)
    assert run() == rest
    if whole:
        assert int(whole[0]) == int(rest[0]) + 14 and whole[1] == "True"
