"""The entry points with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_entry_without_the_training_data_subpackage(tmp_path, gone):
    shutil.copytree(ROOT / "skylark", tmp_path / "skylark", ignore=shutil.ignore_patterns("__pycache__", *gone))
    for name in {"__spark_entry__.py", "corpus_pipeline.py"} - set(gone):
        shutil.copy(ROOT / name, tmp_path)
    said = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout
    names = said.split()
    assert "page_structure" in names and not [n for n in names if n.startswith("op") and n[2].isdigit() or n == "pipeline"]


def test_inventory_names_each_query():
    from skylark.plans import inventory, page_queries, payload_queries, queries  # noqa: F401

    assert set(inventory.OPERATORS) == set(queries.QUERIES)
