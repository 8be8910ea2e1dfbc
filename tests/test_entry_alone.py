"""Without the llm folders and the pipeline, everything else still imports and registers."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_llm(tmp_path):
    shutil.copytree(os.path.join(HERE, "kinweave"), tmp_path / "kinweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(HERE, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'passage_search' in q and set(o) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
    # and its kernels' tests pass there
    shutil.copytree(os.path.join(HERE, "tests"), tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_kernels.py"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=600)
