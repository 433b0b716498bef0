"""The entry module with and without the subpackage of training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'a15_app_usage' in q; print(len([n for n in q if n.startswith('op') or n == 'pipeline']))"


def ask(folder) -> int:
    done = subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(folder)})
    assert done.returncode == 0, done.stderr
    return int(done.stdout.split()[-1])


def test_entry_without_the_subpackage(tmp_path):
    for keep_pipeline in (True, False):
        folder = tmp_path / str(keep_pipeline)
        shutil.copytree(os.path.join(ROOT, "lumenlog"), folder / "lumenlog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (keep_pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py"))):
            shutil.copy(os.path.join(ROOT, name), folder / name)
        assert ask(folder) == 0


def test_entry_names_every_query_once():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
