import pytest

from seamark.llm.common import ready


@pytest.fixture(autouse=True)
def _workers(spark):
    """Python workers find the package however the tests are started."""
    ready(spark)
