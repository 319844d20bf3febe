"""The contract without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), set(o) <= set(q), any(n.startswith('op') for n in q), 'pipeline' in q)"


def told(folder):
    out = subprocess.run([sys.executable, "-c", SAYS], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_imports_without_the_operators_and_without_their_pipeline(tmp_path):
    def skipped(folder, names):
        return [n for n in names if n in (".git", "__pycache__") or n == "llm"]

    shutil.copytree(ROOT, tmp_path / "bare", ignore=skipped)
    n, _, known, operators, pipeline = told(tmp_path / "bare")
    assert int(n) > 100 and (known, operators, pipeline) == ("True", "False", "False")
    os.makedirs(tmp_path / "less")
    for name in ("__spark_entry__.py", "roomgraph"):
        (shutil.copytree if name == "roomgraph" else shutil.copy)(tmp_path / "bare" / name, tmp_path / "less" / name)
    assert told(tmp_path / "less") == told(tmp_path / "bare")
