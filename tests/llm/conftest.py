import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, clashing columns."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, None), (None, "no id here at all", "en", "a", 17), (None, None, None, None, None),
        (4, "same text " * 30, "en", "a", 300), (4, "same text " * 30, "en", "a", 300), (4, "another text with that id", "de", "b", 25), (5, "same text " * 30, "fr", None, 300),
        (6, long, "en", "b", len(long)), (7, "ünïcode ß 漢字 😀 <|endoftext|> x²", "xx", "b", None), (8, "one\r\ntwo\x0bthree\n\n\nfour", "en", "b", 1), (9, "12 34 ___", "en", "a", 9),
    ]
    extra = "`digest` long, `id` string, `host` string, `h` long, `kept` string, `lines` string, `removed` string, `n_words` string, `block` string, `copy` string, `parts` string, `fp` string, `__row` string, `__digest` string, `__id` string, `n_removed` string"
    clash = (7, "id", "host", 1, "kept", "lines", "removed", "n_words", "block", "copy", "parts", "fp", "row", "d", "i", "n")
    return spark.createDataFrame([(*r, *clash) for r in rows], f"{DOCUMENT}, {extra}")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def sf():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no tables")
    return path
