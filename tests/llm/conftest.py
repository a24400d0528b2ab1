import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from driftglass.llm.common import prepare

    prepare(spark)
