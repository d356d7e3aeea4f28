import pytest

import __spark_entry__ as entry

#: Columns whose names clash with those that operators use inside.
CLASH = "n_words int, kept boolean, found string, counts string, size int, taken int, same long, rank int, salt int, spans string"
CLASHING = (7, True, "f", "c", 1, 2, 3, 4, 5, "s")


@pytest.fixture(scope="session")
def llm(spark):
    """The session, with the package sent to Python workers."""
    return entry._ready(spark)


@pytest.fixture
def scratch(llm):
    from rowpact.llm.common import Scratch

    made = Scratch(llm)
    yield made
    made.drop()


@pytest.fixture
def documents(llm):
    """documents([(doc_id, text, lang, source)]), with columns of clashing names."""
    def make(rows):
        return llm.createDataFrame([(*r, len(r[1] or ""), *CLASHING) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")
    return make


LONG = " ".join(f"word{k % 997} and{k}" for k in range(20_000))
#: Nulls, empty and blank texts, a very long text, ties and repeated rows.
EDGES = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\r\x0b\x0c", "en", None), (None, "a text whose id is not known, and it has twelve words in it", "en", "a"),
    (4, LONG, "en", "b"), (5, LONG, "en", "b"), (6, "one", None, "b"), (6, "one", None, "b"), (7, "ünï cödé　wörds ÀÉ 漢字 \U0001F600 x", "de", "é"),
    (8, "same id first text of some words here", "en", "c"), (8, "same id other text of some words there", "en", "c"), (9, "\x00\x01 odd ﻿ bytes", None, None),
]
