import pytest

from vitrine.llm.common import DOCUMENT_COLUMNS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text[, lang[, source]]) -> documents, with an extra column of a clashing name if asked."""

    def make(rows, extra=None):
        full = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        assert df.columns == DOCUMENT_COLUMNS
        if extra:
            from pyspark.sql import functions as F

            for name in extra:
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make


#: NULLs in every column, empty, blank and repeated rows, ties, odd white space, a long text.
ODD = [
    (1, "a b c d e f g", "en", "s1"),
    (1, "a b c d e f g", "en", "s1"),
    (2, "a  b c\nd e f g", "en", None),
    (3, None, None, None),
    (4, "", "de", "s2"),
    (5, " \t\n ", None, "s2"),
    (None, "x y z", "en", "s1"),
    (None, None, None, None),
    (6, "word " * 30_000, "en", "s3"),
    (7, "!!! 123 ###", "fr", "s3"),
    (8, "x" * 70_000, "en", "s1"),
    (9, "\u00e9t\u00e9 \u4e2d\u6587 \U0001f600 a\u00a0b", "fr", "s2"),
]


#: Names that operators and stages use for columns of their own.
CLASH = ["size", "source_size", "copies", "copy", "target", "target_source", "whole", "part", "norm", "name", "row", "fp", "score", "row_id", "kept",
         "quality_score", "quality_kept", "predicted", "best", "key", "piece"]


@pytest.fixture()
def odd(make_docs):
    return make_docs(ODD, extra=CLASH)


@pytest.fixture()
def none(make_docs):
    return make_docs([])
