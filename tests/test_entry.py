import os
import pathlib
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = pathlib.Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(q.startswith('op') or q == 'pipeline' for q in e.queries()))"


def test_names_agree():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and "layerwise_mi" in queries


def test_without_the_subpackage(tmp_path):
    """The other queries are there when probestack/llm and corpus_pipeline.py are not."""
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "probestack", tmp_path / "probestack", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for empty_folder in (False, True):
        if empty_folder:
            (tmp_path / "probestack" / "llm").mkdir()
        said = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True, timeout=120)
        n, m, ops = map(int, said.stdout.split())
        assert n >= m > 50 and ops == 0
