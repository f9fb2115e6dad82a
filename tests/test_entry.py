import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("without", [(), ("tidemark/llm", "corpus_pipeline.py"), ("tidemark/llm",)])
def test_entry_imports_without_a_session(tmp_path, without):
    """Listing the queries needs no session, nor the training-data operators."""
    for name in ("tidemark", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name)
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    for name in without:
        path = tmp_path / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import __spark_entry__ as e; q = set(e.queries()); assert set(e.oracle_sql()) <= q and 'record_head' in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
