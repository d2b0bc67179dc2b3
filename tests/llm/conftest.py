import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, **cols):
        rows = []
        for i, t in enumerate(texts):
            rows.append((cols.get("ids", range(len(texts)))[i], t, (cols.get("langs") or ["en"] * len(texts))[i], (cols.get("sources") or ["a"] * len(texts))[i], len(t or "")))
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


#: Null, empty and wordless texts, ties, repeated rows, null columns.
HARD = [None, "", " \n\t", "...", "a", "A", "a b c d e f g", "A b c d e f g", "日本語 テキスト é", "x" * 20_000, "w " * 5000]


@pytest.fixture
def hard(spark, make_docs):
    docs = make_docs(HARD, langs=[None, "en"] * 5 + ["fr"], sources=[None, "b"] * 5 + ["c"])
    again = docs.where("doc_id = 6")
    nulls = spark.createDataFrame([(None, "a b c d e f g", None, None, None), (None, None, None, None, None)], DOCS)
    return docs.unionByName(again).unionByName(nulls)


@pytest.fixture
def empty(make_docs):
    return make_docs([])
