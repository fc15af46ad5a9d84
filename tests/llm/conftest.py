import duckdb
import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def docs_of(spark):
    """A documents table from texts, (id, text), (id, text, lang) or (id, text, lang, source) rows."""

    def make(rows, extra=()):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            r = (*r, *("en", "s")[len(r) - 2 :])
            full.append((*r[:4], len(r[1]) if r[1] is not None else None, *[f"x{i}" for _ in extra]))
        schema = T.StructType([*DOCS.fields, *[T.StructField(c, T.StringType()) for c in extra]])
        return spark.createDataFrame(full, schema)

    return make


#: Null, empty, blank, repeated and long texts, with a null id, language and source.
ODD = [
    (5, None),
    (1, ""),
    (2, " \n\t "),
    (3, "one two three"),
    (3, "one two three"),
    (None, "a row without an id, long enough to have several words in it"),
    (7, "word " * 30_000, None, None),
    (8, "x" * 5000),
    (9, "ÄÖÜ ß éàè " * 20, "de", "s2"),
    (10, "日本語のテキスト です 。" * 10, None, "s2"),
]
CLASH = ("_id", "size", "length", "place", "kept", "grade", "node", "m")


@pytest.fixture
def odd(docs_of):
    return docs_of(ODD, CLASH)


@pytest.fixture
def empty(docs_of):
    return docs_of([], CLASH)


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) of the smallest test table."""
    return duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY 1").fetchall()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
