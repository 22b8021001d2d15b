"""The driver's contract, with the corpus operators and without them."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_corpus_operators(tmp_path):
    """With both llm folders gone, with corpus_pipeline.py left or gone too, all other queries load, and one of each sort runs."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), 'pipeline' in q, any(k.startswith('op1_') for k in q))"
    said = []
    for _ in range(2):
        run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
        assert run.returncode == 0, run.stderr
        said.append(run.stdout.split())
        (tmp_path / "repo" / "corpus_pipeline.py").unlink(missing_ok=True)
    assert said[0] == said[1] and int(said[0][0]) >= 60 and said[0][1:] == ["False", "False"]
    code = (
        "import __spark_entry__ as e; from loam.session import build; s = build('local[2]', 2, **{'spark.ui.enabled': 'false'}); q = e.queries();"
        "print('ROWS', e.entry(s).count(), *[q[n](s, '/root/testdata/sf0.001').count() for n in ('find_filter', 'header_modes', 'renamed_sources')])"
    )
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr
    assert all(int(x) > 0 for x in run.stdout.rpartition("ROWS")[2].split())


def test_oracles_belong_to_queries():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
