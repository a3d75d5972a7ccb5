import pytest

from wayframe.llm.registry import ready


@pytest.fixture(scope="session")
def sent(spark):
    """The session, with the package at its workers."""
    return ready(spark)


@pytest.fixture
def documents(sent):
    def make(rows, extra=True):
        """(doc_id, text[, source]) rows as documents, with columns whose names the operators use inside."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "x", "x", 1, "x") for r in rows]
        names = "doc_id bigint, text string, lang string, source string, n_chars bigint, y string, size string, lines int, lot string"
        df = sent.createDataFrame(full, names)
        return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")
    return make
