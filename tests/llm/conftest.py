from __future__ import annotations

import pytest

from tests.llm import helpers


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(helpers.odd_rows(), helpers.SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def prose(spark):
    return spark.createDataFrame(helpers.prose_rows(150), helpers.SCHEMA).repartition(5).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], helpers.SCHEMA)
