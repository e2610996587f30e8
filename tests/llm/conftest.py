import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang, source)."""

    def table(rows, extra=()):
        rows = [(*r, *(None,) * (4 - len(r)), None if r[1] is None else len(r[1]), *("x" for _ in extra)) for r in rows]
        return spark.createDataFrame(rows, COLUMNS + "".join(f", {e} string" for e in extra))

    return table


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(small):
    return {r.doc_id: r.text for r in small.select("doc_id", "text").collect()}
