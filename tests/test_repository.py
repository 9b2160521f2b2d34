import os
import subprocess
import sys

from conftest import ROOT


def test_core_does_not_import_llm():
    code = "import sys; sys.modules['evigraph.llm'] = None\nimport evigraph.plans.catalogue, __spark_entry__\nassert not any(n.startswith('evigraph.llm.') for n in sys.modules)\nassert not any(k.startswith(('p1_', 'p3_')) for k in __spark_entry__.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ)


def test_oracles_belong_to_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_tree_without_the_training_data_part(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p3_found' not in q; assert set(e.oracle_sql()) <= set(q); import evigraph.api, evigraph.streaming.events, evigraph.operators.store"
    assert not (tmp_path / "repo" / "evigraph" / "llm").exists()
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={"PYTHONPATH": str(tmp_path / "repo"), "PATH": "/usr/bin:/bin"}, timeout=120)
