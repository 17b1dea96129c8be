"""
NULL category; every operator returns a result instead of failing."""

import pytest

from vitrine.operators import aggregates as A
from vitrine.operators import distributions as D
from vitrine.operators import points as Q
from vitrine.operators import profile as PR
from vitrine.operators import sampling as X
from vitrine.operators import tags as TG

SCHEMA = "id long, g string, y double, tags string, year int"


@pytest.fixture(scope="module")
def frames(spark):
    return {
        "empty": spark.createDataFrame([], SCHEMA),
        "one": spark.createDataFrame([(1, "A", 2.0, "x, y", 2001)], SCHEMA),
        "all_null": spark.createDataFrame([(1, "A", None, None, None), (2, None, None, None, None)],
                                          SCHEMA),
    }


@pytest.mark.parametrize("kind", ["empty", "one", "all_null"])
def test_operators_on_edge_frames(spark, frames, kind):
    df = frames[kind]
    n = df.count()
    assert A.mean_by_category(df, "g", "y").count() <= 1
    assert A.top_categories(df, "g", 3).count() <= 1
    assert A.counts_per_year(df, "year", "g").count() <= 1
    assert A.year_bounds(df, "year").count() == 1
    assert A.row_count(df).first()[0] == n
    assert D.histogram(df, "y", bins=5).count() in (0, 5)
    assert D.box_summary(df, "y").count() <= 1
    assert D.box_summary(df, "y", by="g").count() <= 1
    assert TG.top_tags(df, 5, "tags").count() <= 2
    assert X.stratified_sample(df, "g", 5, ["id"]).count() <= n
    assert X.uniform_sample(df, 5, ["id"]).count() == n
    assert Q.scatter_points(df, "id", "y", ["id"], category="g").count() <= n
    assert PR.missing_share(df).count() == len(df.columns)
    assert PR.describe(df).count() == 3


def test_one_row_values(spark, frames):
    df = frames["one"]
    b = D.box_summary(df, "y").first()
    assert (b.n, b.q1, b.median, b.q3, b.n_outliers) == (1, 2.0, 2.0, 2.0, 0)
    h = D.histogram(df, "y", bins=4).orderBy("bin").collect()
    assert [r["count"] for r in h] == [0, 0, 0, 1]
    assert [tuple(r) for r in TG.top_tags(df, 5, "tags").collect()] == [("x", 1), ("y", 1)]
