import pytest

from revlens.llm.store import ship


@pytest.fixture(scope="session", autouse=True)
def _shipped(spark):
    ship(spark)
