"""The driver's entry, with the llm subpackage, without it, and without what it needs."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
COUNT = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"


def counted(folder: Path, before: str = "") -> list[str]:
    return subprocess.run([sys.executable, "-c", before + COUNT], cwd=folder, check=True, capture_output=True, text=True).stdout.split()


@pytest.fixture
def copy(tmp_path):
    for name in ("tickforge", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    return tmp_path


def test_without_the_folder(copy):
    shutil.rmtree(copy / "tickforge" / "llm", ignore_errors=True)
    total, operators, pipeline = counted(copy)  # corpus_pipeline.py still there
    assert int(total) > 40 and (operators, pipeline) == ("0", "False")
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert counted(copy) == [total, operators, pipeline]


def test_without_a_package(copy):
    total, operators, pipeline = counted(copy, "import sys; sys.modules['xxhash'] = None; ")
    assert int(total) > 40 and (operators, pipeline) == ("0", "False")


def test_whole(copy):
    if not (copy / "tickforge" / "llm").exists():
        pytest.skip("the subpackage is not installed")
    total, operators, pipeline = counted(copy)
    assert (operators, pipeline) == ("10", "True") and int(total) > 50
