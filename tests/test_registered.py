"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from checks import oracle, queries
from checks.compare import connect, difference
from litrewise.placement import settled_within

SF = "/root/testdata/sf0.001"
SLOW = {"model_rf", "model_gbt", "model_comparison", "model_lr"}


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(queries.registered()) - SLOW))
def test_equals_sql(spark, connection, name):
    with settled_within(spark):
        assert difference(queries.registered()[name](spark, SF), connection, oracle.statements()[name]) is None


def test_all_but_full_size_models_have_sql():
    assert set(queries.registered()) - set(oracle.statements()) == SLOW


ROOT = Path(__file__).resolve().parent.parent
LISTED = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_works_without_the_training_data_folders(tmp_path, pipeline):
    """Also where the pipeline's file is still there."""
    for folder in ("litrewise", "checks"):
        shutil.copytree(ROOT / folder, tmp_path / folder, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for file in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])]:
        if (ROOT / file).exists():
            shutil.copy(ROOT / file, tmp_path)
    done = subprocess.run(
        [sys.executable, "-c", LISTED], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, capture_output=True, text=True
    )
    assert done.returncode == 0, done.stderr
    names, statements = json.loads(done.stdout)
    assert names == sorted(queries.registered()) and statements == sorted(oracle.statements())
