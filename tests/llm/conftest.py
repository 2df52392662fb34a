import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text) or (doc_id, text, lang) as documents, with columns that clash with names used inside."""

    def make(rows, clash=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOC)
        if clash:
            for name in ("node", "doc", "th", "score", "a", "b", "rank", "bin", "__node", "bucket", "owner", "s", "n", "key"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


ODD = [
    (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "!!! ??? ---"), (5, "one"), (5, "one"), (None, "one two three four five"), (None, None), (6, "é" * 300 + " ünïcödé 漢字 text"), (7, "word " * 3000),
]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs([(*r, None) if k % 3 == 0 else r for k, r in enumerate(ODD)], clash=True)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([]).where("false")
