import pytest
from oracle import compare

from weftline.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, sf, name):
    compare(spark, sf, registry.QUERIES[name], registry.SQL[name])


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
