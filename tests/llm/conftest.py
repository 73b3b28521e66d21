import pytest

from siltbed.llm import pseudonyms


@pytest.fixture(autouse=True)
def pii_key(spark):
    spark.conf.set(pseudonyms.KEY_SETTING, "a key for tests")
