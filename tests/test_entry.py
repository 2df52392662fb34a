import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"keyword", "cnt", "prev_cnt", "delta", "rising"}


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_corpus_folders(tmp_path):
    """The entry module and all other queries work where the corpus operators aren't installed; another missing import isn't hidden."""
    for name in ("__spark_entry__.py", "tidewheel"):
        source = os.path.join(ROOT, name)
        (shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path / name))
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and done.stdout.split()[1] == "False", done.stderr
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_missing\n")
    broken = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert broken.returncode != 0 and "a_module_that_is_missing" in broken.stderr
