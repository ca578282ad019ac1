"""The library and its queries stand without the subpackage for training data."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry_without_the_subpackage(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name.startswith('tesserae.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries())\n"
        "assert names and set(e.oracle_sql()) <= names and not any(n.startswith('op') or n == 'pipeline' for n in names)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


def test_nothing_else_imports_it():
    for path in (REPO / "tesserae").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "tesserae.llm" not in path.read_text(), path
