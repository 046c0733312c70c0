"""The registry works without the training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_core_queries_without_the_training_data_part(tmp_path):
    shutil.copytree(ROOT / "textweir", tmp_path / "textweir", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / f).exists():
            shutil.copy(ROOT / f, tmp_path)
    code = "import __spark_entry__ as e; from textweir.plans import registry as r; assert set(e.queries()) == set(r.QUERIES) and e.oracle_sql() == r.ORACLES and len(r.QUERIES) > 100"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
