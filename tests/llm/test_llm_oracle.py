import pytest

from tests.test_oracle import QUERIES, check, con  # noqa: F401


@pytest.mark.parametrize("name", [n for n in QUERIES if QUERIES[n].__module__.startswith("quarterloom.llm")])
def test_query(spark, con, name):  # noqa: F811
    check(spark, con, name)
