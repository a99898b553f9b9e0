import pytest


@pytest.fixture(scope="session", autouse=True)
def workers_import(spark):
    from moltab.llm.common import importable
    importable(spark)
