"""The entry module works with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_llm_folders(tmp_path):
    for name in ("compactcodec", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "compactcodec/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_library_does_not_import_the_llm_folder():
    for folder, _, files in os.walk(os.path.join(ROOT, "compactcodec")):
        if not folder.endswith("llm"):
            for f in (f for f in files if f.endswith(".py")):
                with open(os.path.join(folder, f), encoding="utf-8") as source:
                    assert "compactcodec.llm" not in source.read(), f
