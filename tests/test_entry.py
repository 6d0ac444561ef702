import importlib
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_contract():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "q01_bm25" in entry.queries()


def test_nothing_imports_the_optional_subpackage():
    for path in (ROOT / "siltstone").rglob("*.py"):
        if path.parent.name != "llm":
            assert "siltstone.llm" not in path.read_text(), path


def test_entry_works_without_it():
    body = "import sys; sys.modules['siltstone.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('p1_') for n in e.queries())"
    subprocess.run([sys.executable, "-c", body], cwd=ROOT, check=True, timeout=120)
