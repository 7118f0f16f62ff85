import os

import pytest
from oracle import compare

from weftline.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, name):
    compare(spark, SF, registry.QUERIES[name], registry.SQL[name])


def test_every_query_has_sql_but_the_keys():
    assert set(registry.QUERIES) - set(registry.SQL) == {"stream_keys"}


def test_stream_keys_agree_with_plain_python(spark):
    import zlib

    from weftline.functions.hashes import crc32c, stream_key
    from weftline.schema import read_events

    data = {(r.stream, r.version): r.data.encode() for r in read_events(spark, SF).collect()}
    for r in registry.QUERIES["stream_keys"](spark, SF).collect():
        own = data[r.stream, r.version]
        assert (r.stream_hash, r.crc32, r.crc32c, r.adler32) == (stream_key(r.stream), zlib.crc32(own), crc32c(own), zlib.adler32(own))


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
