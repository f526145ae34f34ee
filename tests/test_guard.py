"""The entry module works without the subpackage llm and the pipeline, and hides no other import error."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def run(folder, code):
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True)


def test_without_llm(tmp_path):
    shutil.copytree(ROOT / "ripplerank", tmp_path / "ripplerank", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = run(tmp_path, "import __spark_entry__ as e; q = e.queries(); assert 'fold_margins' in q and not any(k.startswith('op1') for k in q) and set(e.oracle_sql()) <= set(q)")
    assert out.returncode == 0, out.stderr
    (tmp_path / "ripplerank" / "plans" / "registry.py").write_text("import no_such_module\n")
    assert "no_such_module" in run(tmp_path, "import __spark_entry__").stderr


def test_without_llm_but_with_the_pipeline_file(tmp_path):
    shutil.copytree(ROOT / "ripplerank", tmp_path / "ripplerank", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(ROOT / f, tmp_path)
    out = run(tmp_path, "import __spark_entry__ as e; q = e.queries(); assert 'fold_margins' in q and 'pipeline' not in q and not any(k.startswith('op1') for k in q)")
    assert out.returncode == 0, out.stderr


def test_nothing_imports_llm():
    for f in (ROOT / "ripplerank").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "llm" not in f.read_text(), f
