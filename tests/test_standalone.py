"""The library without its optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_corpus_folder(tmp_path, pipeline):
    shutil.copytree(os.path.join(ROOT, "tablesmith"), tmp_path / "tablesmith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    if pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    queries, oracles, corpus = out.stdout.split()
    assert int(queries) > 150 and int(oracles) > 150 and corpus == "False"


def test_nothing_else_needs_the_corpus_folder():
    for folder, _, names in os.walk(os.path.join(ROOT, "tablesmith")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert "tablesmith.llm" not in f.read(), n
