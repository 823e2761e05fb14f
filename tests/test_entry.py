"""The entry module with and without the subpackage of training-data operators."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
BLOCK = "import sys; sys.modules[{!r}] = None; "


def asked(where: Path, before: str = "") -> tuple[set, set]:
    said = subprocess.run([sys.executable, "-c", before + ASK], cwd=where, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})
    assert said.returncode == 0, said.stderr
    names, sql = map(set, json.loads(said.stdout.splitlines()[-1]))
    assert sql <= names
    return names, sql


@pytest.fixture(scope="module")
def core():
    from complyspark.plans import registry

    return set(registry.QUERIES)


def copied(to: Path, *without: str) -> Path:
    shutil.copytree(ROOT, to, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__") or (Path(d) / n).relative_to(ROOT).as_posix() in without])
    return to


@pytest.mark.parametrize("without", [("complyspark/llm", "tests/llm"), ("complyspark/llm", "tests/llm", "corpus_pipeline.py")])
def test_rest_without_subpackage(tmp_path, core, without):
    where = copied(tmp_path / "repo", *without)
    assert asked(where)[0] == core
    said = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=where, capture_output=True, text=True)
    assert said.returncode == 0, said.stdout + said.stderr
    said = subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_functions.py", "tests/test_queries.py::test_entry"], cwd=where, capture_output=True, text=True)
    assert said.returncode == 0, said.stdout + said.stderr


@pytest.mark.parametrize("module", ["xxhash", "tokenizers"])
def test_missing_dependency_leaves_core_queries(core, module):
    assert asked(ROOT, BLOCK.format(module))[0] >= core
