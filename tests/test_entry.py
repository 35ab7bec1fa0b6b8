"""The driver entry with and without the training-data folder."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PRINT = "import __spark_entry__ as e; print(len(e.queries()), *[n for n in e.queries() if n == 'pipeline' or n[:2] == 'op'])"


@pytest.mark.parametrize("left", ["nothing", "pipeline", "empty folder"])
def test_entry_without_the_training_data_folder(tmp_path, left):
    shutil.copytree(f"{ROOT}/cohortwise", tmp_path / "cohortwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if left != "nothing" and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    if left == "empty folder":
        (tmp_path / "cohortwise" / "llm").mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    found = subprocess.run([sys.executable, "-c", PRINT], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert found.returncode == 0, found.stderr[-2_000:]
    count, *names = found.stdout.split()
    assert int(count) > 100 and not names
