import pytest


@pytest.fixture(autouse=True)
def tables_go(spark):
    """What the results of a test's operators read is deleted after it."""
    from assay.llm.common import release

    yield
    release(spark)
