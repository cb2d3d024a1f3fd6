import pytest

AWKWARD = (
    "doc_id long, text string, lang string, source string, n_chars long, sig string, token int, `key` string, first long,"
    " _row string, _first string, _class string, _id string, _least string, _mix_p string, _mix_source string"
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names the operators use themselves."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, None if k % 3 == 0 else "en", f"src{k % 2}" if k % 5 else None, 0, "x", 1, "y", 2, *(f"{c}{k}" for c in "rfcilps")) for k, (i, t) in enumerate(zip(ids, texts))]
        return spark.createDataFrame(rows, AWKWARD)

    return make
