
import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import aggregates as A
from vitrine.operators import distributions as D
from vitrine.operators import merge as M
from vitrine.operators import predicates as PD
from vitrine.operators import profile as PR
from vitrine.operators import sampling as X
from vitrine.operators import series as R
from vitrine.operators import tags as TG


def test_densify_reference_gaps(spark):
    # FIXTURES §4: (2010,A,1) (2010,B,2) (2012,A,3) (2015,B,4), years 2010-2013
    c = spark.createDataFrame([(2010, "A", 1), (2010, "B", 2), (2012, "A", 3), (2015, "B", 4)],
                              "y int, g string, n bigint")
    out = R.yearly_series(c, "y", "g", "n", 2010, 2013, requested=["A", "B"])
    got = {(r.g, r.y): r.n for r in out.collect()}
    assert [got[("A", y)] for y in range(2010, 2014)] == [1, 0, 3, 0]
    assert [got[("B", y)] for y in range(2010, 2014)] == [2, 0, None, 0]
    assert out.count() == (2013 - 2010 + 1) * 2
    zero = R.yearly_series(c, "y", "g", "n", 2010, 2013, requested=["A", "B"], gap="zero")
    assert {(r.g, r.y): r.n for r in zero.collect()}[("B", 2012)] == 0


def test_densify_none_requested_present(spark):
    c = spark.createDataFrame([(2010, "A", 1)], "y int, g string, n bigint")
    assert R.yearly_series(c, "y", "g", "n", 2010, 2011, requested=["Z"],
                           variant="count").count() == 2
    assert R.yearly_series(c, "y", "g", "n", 2010, 2011, requested=["Z"],
                           variant="sum").count() == 0
    assert R.yearly_series(c, "y", "g", "n", 2012, 2011).count() == 0


def test_pivot_melt_identity(spark):
    c = spark.createDataFrame([(1, "a", 2), (1, "b", 3), (2, "a", 4)], "y int, g string, n int")
    back = R.melt_long(R.pivot_wide(c, "y", "g", "n", ["a", "b"]), "y", "g", "n")
    assert sorted(tuple(r) for r in back.where("n is not null").collect()) == \
        sorted(tuple(r) for r in c.collect())


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "v double")
    counts = [r["count"] for r in D.histogram(df, "v", bins=5).orderBy("bin").collect()]
    assert counts == [0, 0, 0, 0, 3]


@pytest.mark.parametrize("log_bins", [False, True])
def test_histogram_matches_numpy(spark, log_bins):
    rng = np.random.default_rng(7)
    vals = np.round(rng.lognormal(3, 1.2, 3000), 2).tolist() + [0.01, 1000.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    h = D.histogram(df, "v", bins=37, log_bins=log_bins).orderBy("bin").collect()
    edges = D.bin_edges(min(vals), max(vals), 37, log_bins)
    expected, _ = np.histogram(np.array(vals), bins=edges)
    assert [r["count"] for r in h] == expected.tolist()
    assert sum(r["count"] for r in h) <= len(vals)


def test_histogram_empty(spark):
    df = spark.createDataFrame([("x",), (None,)], "v string")
    assert D.histogram(df, "v").count() == 0


def test_stratified_quotas_exact_and_repeatable(spark):
    # FIXTURES §4: strata 620/145/129/106 with n=137 -> 85/20/18/14
    rows = [(i, g) for g, k in (("en", 620), ("fr", 145), ("de", 129), ("es", 106))
            for i in range(k)]
    rows = [(n, g) for n, (_, g) in enumerate(rows)] + [(5000 + i, None) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, g string")
    s1 = X.stratified_sample(df, "g", 137, ["id"])
    counts = {r.g: r["count"] for r in s1.groupBy("g").count().collect()}
    assert counts == {"en": 85, "fr": 20, "de": 18, "es": 14}
    s2 = X.stratified_sample(df.repartition(7), "g", 137, ["id"])
    assert sorted(r.id for r in s1.collect()) == sorted(r.id for r in s2.collect())


def test_stratified_edges(spark):
    df = spark.createDataFrame([(i, None) for i in range(10)], "id long, g string")
    assert X.stratified_sample(df, "g", 4, ["id"]).count() == 4  # no stratum -> uniform
    assert X.stratified_sample(df, "missing", 3, ["id"]).count() == 3
    assert X.stratified_sample(df, "g", 0, ["id"]).count() == 10


def test_stratified_shortfall_redraw(spark):
    # a quota of nearly all of its stratum
    df = spark.range(2000).withColumn("g", (F.col("id") % 3).cast("string"))
    s = X.stratified_sample(df, "g", 90, ["id"])
    assert {r.g: r["count"] for r in s.groupBy("g").count().collect()} == \
        {"0": 30, "1": 30, "2": 30}


def test_uniform_sample(spark):
    df = spark.range(100)
    s = X.uniform_sample(df, 10, ["id"])
    assert s.count() == 10
    assert X.uniform_sample(df, 1000, ["id"]).count() == 100
    narrow = X.uniform_sample(df.repartition(3), 10, ["id"])
    assert sorted(r.id for r in narrow.collect()) == sorted(r.id for r in s.collect())


def test_samples_are_the_smallest_ranks(spark):
    """The rows with the smallest md5 ranks, of all rows or of each stratum, also with equal keys."""
    import hashlib
    ids = list(range(300)) + [7] * 40
    df = spark.createDataFrame([(i, f"g{i % 4}" if i % 9 else None, n) for n, i in enumerate(ids)], "id long, g string, n long")
    rank = lambda r: (hashlib.md5(f"1|{r.id}".encode()).hexdigest(), r.id, r.g, r.n)
    rows = sorted(df.collect(), key=lambda r: rank(r)[0])
    for n in (1, 30, 41, 339, 340, 400):
        got = X.uniform_sample(df, n, ["id"]).collect()
        assert len(got) == min(n, 340)
        assert {r.id for r in got} == {r.id for r in rows[:n]}
    for n in (10, 100):
        got = X.stratified_sample(df, "g", n, ["id"]).collect()
        for g in {r.g for r in rows} - {None}:
            mine = [r.id for r in got if r.g == g]
            assert sorted(mine) == sorted(r.id for r in [r for r in rows if r.g == g][: len(mine)])
    assert X.stratified_sample(df, "g", 340, ["id"], keep_small=True).count() == 340


def test_keep_first(spark):
    a = spark.createDataFrame([(1, "a1", 0, 0), (2, "a2", 0, 1), (None, "an", 0, 2)],
                              "k int, v string, pr int, pos int")
    b = spark.createDataFrame([(1, "b1", 1, 0), (3, "b3", 1, 1), (None, "bn", 1, 2)],
                              "k int, v string, pr int, pos int")
    out = M.keep_first(M.union_all(a, b), "k", ["pr", "pos"])
    assert sorted((r.k or 0, r.v) for r in out.collect()) == [(0, "an"), (1, "a1"), (2, "a2"),
                                                             (3, "b3")]


def test_mean_by_category_semantics(spark):
    df = spark.createDataFrame(
        [("A", "1"), ("A", "x"), ("B", None), ("C", "3"), (None, "9"), ("D", "2")],
        "g string, y string")
    a1 = A.mean_by_category(df, "g", "y", top_n=10)
    assert [(r.g, r.y) for r in a1.collect()] == [("C", 3.0), ("D", 2.0), ("A", 1.0)]
    a5 = A.mean_by_category(df, "g", "y", top_n=10, drop_missing_means=False)
    assert [(r.g, r.y) for r in a5.collect()][-1] == ("B", None)
    sel = A.mean_by_category(df, "g", "y", top_n=10, selected="A")
    assert [r.g for r in sel.collect()] == ["A"]


def test_sum_per_year_all_missing_is_zero(spark):
    df = spark.createDataFrame([(2000, "A", None), (2000, "A", None)], "y int, g string, v double")
    out = A.sum_per_year(df, "y", "g", "v", selected=["A"])
    assert out.first()["sum"] == 0.0


def test_year_bounds_defaults(spark):
    empty = spark.createDataFrame([], "y int")
    r = A.year_bounds(empty, "y").first()
    assert tuple(r) == (1970, 2025, 2010, 2020)
    r = A.year_bounds(spark.createDataFrame([(2001,), (2019,)], "y int"), "y").first()
    assert tuple(r) == (2001, 2019, 2009, 2019)


def test_crosstab_drops_absent(spark):
    df = spark.createDataFrame([(2000, "A"), (2000, "A"), (2001, "B")], "y int, g string")
    out = A.year_category_crosstab(df, "y", "g", ["A", "B", "Z"])
    assert out.columns == ["y", "A", "B"]
    assert [tuple(r) for r in out.collect()] == [(2000, 2, 0), (2001, 0, 1)]


def test_comparator_rules(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "y double")
    assert PD.compare(df, "y", "ge", 1).count() == 2
    assert PD.compare(df, "y", "ge", "abc").count() == 3   # non-numeric: skipped
    assert PD.compare(df, "y", "zz", 1).count() == 3       # unknown op: skipped
    assert PD.compare(df, "y", None, 1).count() == 3
    assert PD.hide_zero(df, "y").count() == 2


def test_box_summary_whiskers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([(v, "g") for v in vals], "v double, k string")
    r = D.box_summary(df, "v").first()
    q1, q3 = np.percentile(vals, [25, 75])
    assert (r.q1, r.q3) == (q1, q3)
    assert r.upper_whisker == 5.0 and r.n_outliers == 1 and r.lower_whisker == 1.0
    g = D.box_summary(df, "v", by="k").first()
    assert g.median == np.percentile(vals, 50)


def test_top_tags_missing_column(spark):
    df = spark.createDataFrame([("a",)], "x string")
    assert TG.top_tags(df, 5, "tags").count() == 0
    card = TG.dataset_card(spark.createDataFrame([("x, y",), ("y",)], "categories_top string"))
    assert card.first().top_tags == "y (2), x (1)"


def test_profile(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, "a", float("nan"))], "a int, b string, c double")
    ms = {r.column_name: r.missing_share for r in PR.missing_share(df).collect()}
    assert ms == {"a": 0.0, "b": 0.5, "c": 0.5}
    d = {r.column_name: r for r in PR.describe(df).collect()}
    assert set(d) == {"a", "c"} and d["c"]["count"] == 1 and d["a"].std == pytest.approx(0.7071, 1e-3)
    info = [tuple(r) for r in PR.column_info(df).orderBy("position").collect()]
    assert info == [(0, "a", "int", 2), (1, "b", "string", 1), (2, "c", "double", 2)]


@pytest.mark.parametrize("sketch_k,final_rows", [(8, 5), (100, 5), (1600, 100_000)])
def test_exact_quantiles_match_numpy(spark, sketch_k, final_rows):
    from vitrine.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(3)
    a = np.concatenate([rng.normal(0, 1e4, 700), np.full(300, 7.5), [-1e-300, 0.0, 1e300]])
    b = rng.integers(0, 5, 200).astype(float)
    rows = [("a", float(v)) for v in a] + [("b", float(v)) for v in b] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.25, 0.5, 0.75, 0.9]
    out = {r.g: r for r in exact_quantiles(df, "v", probs, by=["g"], sketch_k=sketch_k,
                                           final_rows=final_rows).collect()}
    assert set(out) == {"a", "b"}
    for g, vals in (("a", a), ("b", b)):
        exp = np.percentile(vals, [p * 100 for p in probs])
        got = [out[g][f"q{i}"] for i in range(len(probs))]
        assert got == pytest.approx(exp.tolist(), rel=1e-12, abs=1e-9)
        assert out[g].n == len(vals) and out[g]["min"] == vals.min()


def test_long_selection_semi_join(spark):
    df = spark.createDataFrame([(str(i % 50),) for i in range(200)], "g string")
    sel = [str(i) for i in range(1500)]
    assert PD.in_categories(df, "g", sel).count() == 200
    assert PD.in_categories(df, "g", sel[10:]).count() == 160


def test_grouped_histogram_matches_numpy(spark):
    rng = np.random.default_rng(11)
    groups = {"a": np.round(rng.normal(50, 20, 500), 1), "b": np.full(7, 3.0),
              "c": np.round(rng.uniform(0, 1, 300), 3)}
    rows = [(g, float(v)) for g, vals in groups.items() for v in vals] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = D.grouped_histogram(df, "v", "g", bins=13).collect()
    for g, vals in groups.items():
        got = [r["count"] for r in sorted((r for r in out if r.g == g), key=lambda r: r.bin)]
        exp, _ = np.histogram(vals, bins=np.linspace(vals.min(), vals.max(), 14))
        assert got == exp.tolist(), g


def test_infer_types(spark):
    from vitrine.sources.csv import infer_types
    rows = [("1", "1", "1.5", "True", "x", None, " 7 "), ("2", None, "inf", "false", "1", None, "8")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, "
                                     "f string, g string")
    out = infer_types(df)
    assert dict(out.dtypes) == {"a": "bigint", "b": "double", "c": "double", "d": "boolean",
                                "e": "string", "f": "double", "g": "bigint"}
    assert [tuple(r) for r in out.collect()] == [(1, 1.0, 1.5, True, "x", None, 7),
                                                 (2, None, float("inf"), False, "1", None, 8)]


def test_samples_deterministic_with_duplicate_keys(spark):
    # keys repeat with different payloads: the draw must not depend on order
    df = spark.range(3000).selectExpr("id % 97 AS k", "id AS payload",
                                      "CAST(id % 4 AS STRING) AS g")
    def draw(d):
        s = X.stratified_sample(d, "g", 101, ["k"])
        u = X.uniform_sample(d, 57, ["k"])
        return (sorted(r.payload for r in s.collect()), sorted(r.payload for r in u.collect()))
    assert draw(df) == draw(df.repartition(11)) == draw(df.orderBy(F.desc("payload")))
