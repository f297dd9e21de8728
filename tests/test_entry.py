"""The driver's entry, with and without the text subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_text_subpackage(tmp_path):
    shutil.copytree(os.path.join(ROOT, "quietsignal"), tmp_path / "quietsignal", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'zscore_events' in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_text_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "quietsignal")):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                assert "quietsignal.llm" not in open(os.path.join(folder, n)).read()
