import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_imports_without_the_training_operators(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("voxspark", "corpus_pipeline.py", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "voxspark").mkdir()
    for p in (ROOT / "voxspark").iterdir():
        if p.name != "llm":
            (tmp_path / "voxspark" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 90 and not any(k.startswith('op1_') or k == 'pipeline' for k in n)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
