import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, fp long, `row` string, score double, copies int"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 7, "k", 1, "r", 0.5, 3) for i, t, s in ((*r, "a")[:3] for r in rows)], SCHEMA)

    return make
