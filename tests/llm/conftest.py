import pytest


@pytest.fixture(scope="session")
def bodies(spark):
    """Makes a message scan with the given bodies; extra columns clash with the jobs' own."""
    def make(*texts, rowids=None):
        rowids = list(range(len(texts))) if rowids is None else rowids
        rows = [(i, 7, t, "+15555550101", "x", -1) for i, t in zip(rowids, texts, strict=True)]
        return spark.createDataFrame(
            rows, "rowid long, chat_rowid long, text string, handle_raw string, "
                  "fp string, n_tokens int")
    return make


#: Bodies every job must get through: nothing, blanks, ties, long ones, odd characters.
ODD = (None, "", " \t\n", "one", "one", "Ünï côdé 漢字 😀\x00 end", "a b c " * 4000)
