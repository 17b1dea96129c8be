"""CSV fidelity, infinities, one quantile path, owner-range dispatch."""

import math

import numpy as np
import pandas as pd
import pytest

from vitrine.operators import aggregates as A
from vitrine.operators import distributions as D
from vitrine.operators import points as Q
from vitrine.operators import profile as PR
from vitrine.operators.quantiles import exact_quantiles
from vitrine.session import scratch_path
from vitrine.sources import csv as CSV

INF = float("inf")


def test_csv_keeps_blanks_and_big_integers(spark):
    cells = [("  pad  ", "99999999999999999999", "1"), ("\tx ", "1", "2"), ('q"u, \n o', "-5", "9223372036854775807")]
    path = CSV.write_csv(spark.createDataFrame(cells, "a string, b string, c string"), scratch_path(spark, "t"))
    back = CSV.infer_types(CSV.read_csv(spark, path))
    assert dict(back.dtypes) == {"a": "string", "b": "string", "c": "bigint"}
    assert sorted(map(tuple, back.collect())) == sorted((a, b, int(c)) for a, b, c in cells)


def test_csv_out_of_range_integers_with_gaps_stay_text(spark):
    df = spark.createDataFrame([("9223372036854775808",), (None,), ("1",)], "a string")
    assert CSV.infer_types(df).dtypes == [("a", "string")]


def test_csv_infinite_text_is_double(spark):
    df = spark.createDataFrame([("inf",), ("1.5",), ("-Infinity",)], "a string")
    assert sorted(r[0] for r in CSV.infer_types(df).collect()) == [-INF, 1.5, INF]


def _frame(spark, values, group=None):
    return spark.createDataFrame([(group, v) for v in values], "g string, v double")


def test_histogram_counts_infinities_in_the_outer_bins(spark):
    rows = D.histogram(_frame(spark, [0.0, 1.0, 2.0, 4.0, INF, INF, -INF]), "v", bins=4).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [2, 1, 1, 3]
    assert rows[0].bin_left == 0.0 and rows[-1].bin_right == 4.0
    assert D.histogram(_frame(spark, [INF, -INF]), "v").count() == 0


def test_histogram_log_x_keeps_equal_widths(spark):
    rows = D.histogram(_frame(spark, [-1.0, 0.0, 1.0, 2.0, 5.0]), "v", bins=4, log_x=True).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [1, 1, 0, 1] and [r.bin_left for r in rows] == [1.0, 2.0, 3.0, 4.0]


def test_grouped_histogram_with_infinities(spark):
    df = _frame(spark, [1.0, 2.0, 3.0, INF], "a").unionByName(_frame(spark, [INF], "b"))
    rows = D.grouped_histogram(df, "v", "g", bins=2).orderBy("g", "bin").collect()
    assert [(r.g, r["count"]) for r in rows] == [("a", 1), ("a", 3)]


DATA = {
    "ties": [1.0] * 50 + [2.0] * 30 + [3.0],
    "negatives": [-5.0, -1.0, -1.0, 0.0, 0.0, 7.0, 9.5],
    "infinities": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, INF, INF],
    "both ends": [-INF, -INF, 0.0, INF],
    "denormals": [5e-324, 1e-323, 1.5e-323, 1e-310, 0.0, -5e-324],
    "random": np.random.default_rng(0).uniform(0, 1000, 2002).tolist(),
    "wide": (10.0 ** np.random.default_rng(1).uniform(-300, 300, 500)).tolist(),
}
PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize("name", DATA)
def test_quantiles_do_not_depend_on_the_rows_ranked_together(spark, name):
    df = _frame(spark, DATA[name], "k")
    want = None
    for final_rows in (1, 7, 100_000):
        row = exact_quantiles(df, "v", PROBS, by=["g"], final_rows=final_rows).first()
        got = [row[f"q{i}"] for i in range(len(PROBS))]
        if want is None:
            want = got
        assert all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(got, want))
    with np.errstate(invalid="ignore"):
        pandas = pd.Series(DATA[name]).quantile(PROBS).tolist()
    for p, a, b in zip(PROBS, want, pandas):
        rank = (len(DATA[name]) - 1) * p
        if rank == int(rank):  # on an order statistic: itself
            assert a == sorted(DATA[name])[int(rank)]
        elif name == "both ends":
            assert a == -INF if p < 0.6 and rank > 1 else (math.isnan(a) or a == INF)
        else:
            assert (math.isnan(a) and math.isnan(b)) or a == b or a == pytest.approx(b, rel=1e-12)


def test_describe_of_an_empty_column(spark):
    rows = PR.describe(_frame(spark, [None, None]), ["v"]).collect()
    assert [(r["count"], r["mean"], r["q50"]) for r in rows] == [(0, None, None)]


def test_owner_range_column_is_read_as_a_range(spark):
    df = spark.createDataFrame([("a", "10 - 20", 1.0, 1), ("a", "30 - 40", 2.0, 2), ("b", "0 - 2", 3.0, 3)],
                               "main_genre string, estimated_owners string, price double, k int")
    rows = A.mean_by_category(df, "main_genre", "estimated_owners").collect()
    assert [(r.main_genre, r.estimated_owners_mid_mean) for r in rows] == [("a", 25.0), ("b", 1.0)]
    points = Q.scatter_points(df, "price", "estimated_owners", ["k"]).orderBy("k").collect()
    assert [r.y_mid for r in points] == [15.0, 35.0, 1.0]


def test_year_label_falls_back_to_the_text(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, "soon"), (2, 1.0, 2.0, None)], "k int, x double, y double, release_date string")
    rows = Q.scatter_points(df, "x", "y", ["k"]).orderBy("k").collect()
    assert [r.release_year for r in rows] == ["soon", ""]
