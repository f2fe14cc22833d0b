import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op1') for n in e.queries()))"


def counts(folder):
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    queries, oracles, numbered = out.stdout.split()
    return int(queries), int(oracles), numbered == "True"


def test_imports_without_the_training_data_part(tmp_path):
    def without_llm(folder, names):
        return [n for n in names if n == "__pycache__" or (n == "llm" and os.path.basename(folder) == "siftwire")]

    shutil.copytree(os.path.join(ROOT, "siftwire"), tmp_path / "siftwire", ignore=without_llm)
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    queries, oracles, numbered = counts(tmp_path)
    from siftwire.plans.catalog import QUERIES
    from siftwire.plans.oracles import ORACLES

    assert (queries, oracles, numbered) == (len(QUERIES), len(ORACLES), False)
    if os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), tmp_path)
        assert counts(tmp_path) == (len(QUERIES), len(ORACLES), False)
