import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names operators use inside or add.
CLASHING = ", _id long, _source string, size long, n long, rep long, key long, n_lines string, score string, _label int, id string"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text, source) rows, with extra columns of clashing names."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x", 2, 3, 4, 5, "y", "z", 6, "i") for i, t, s in rows], DOCUMENT + CLASHING)

    return make
