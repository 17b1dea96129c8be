"""Clustered ingest with observed metrics, bucketed snapshots, the one-pass card, whole-column quantiles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import distributions as D
from vitrine.operators import merge as M
from vitrine.operators import predicates as PD
from vitrine.operators import profile as PR
from vitrine.operators import tags as TG
from vitrine.operators.quantiles import column_quantiles
from vitrine.sources.ingest import metrics_table, write_clustered


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- ingest


def test_clustered_write_prunes_and_measures(spark, tmp_path):
    rows = [(i, 1990 + i % 5 if i % 7 else None, f"g{i % 50}" if i % 3 else None, math.nan if i % 11 == 0 else i / 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, release_year int, main_genre string, price double")
    got = write_clustered(df, str(tmp_path / "t"))
    assert got.rows == 2000 and got.least["release_year"] == 1990 and got.greatest["id"] == 1999
    assert got.non_null == {r.column_name: r.non_null for r in PR.column_info(df).collect()}
    share = {r.column_name: r.missing_share for r in PR.missing_share(df, 10).collect()}
    assert {r.column_name: pytest.approx(r.missing_share) for r in metrics_table(df, got).collect()} == share
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    some = PD.in_categories(PD.year_between(back, "release_year", 1991, 1992), "main_genre", ["g1", "g7"])
    plan = plan_of(some)
    assert "PartitionFilters: [isnotnull(release_year" in plan and "1991" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "PushedFilters: [In(main_genre" in plan
    assert some.count() == sum(r[1] in (1991, 1992) and r[2] in ("g1", "g7") for r in rows)
    assert {f.split("release_year=")[1].split("/")[0] for f in some.inputFiles()} >= {"1991", "1992"}


def test_clustered_files_carry_bloom_filters(spark, tmp_path):
    """A value within the range of a row group but not in it is ruled out by the Bloom filter."""
    import pyarrow.parquet as pq
    df = spark.createDataFrame([(1, 2000, f"g{2 * i}") for i in range(500)], "id long, release_year int, main_genre string")
    write_clustered(df, str(tmp_path / "t"))
    files = spark.read.parquet(str(tmp_path / "t")).inputFiles()
    sizes = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in files]
    assert sum(m.num_rows for m in sizes) == 500
    flags = {str(pq.ParquetFile(f.removeprefix("file://")).schema_arrow.names) for f in files}
    assert flags == {"['id', 'main_genre']"}


def test_clustered_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "release_year int, main_genre string")
    got = write_clustered(df, str(tmp_path / "t"))
    assert got.rows == 0 and [r.missing_share for r in metrics_table(df, got).collect()] == [None, None]


# ---------------------------------------------------------------- snapshots


@pytest.mark.parametrize("null_key", [False, True])
def test_merge_into_snapshot_is_keep_first(spark, null_key):
    old = [(i, f"o{i}") for i in range(100)] + [(None, "old null")]
    new = [(i, f"n{i}", p) for i in range(90, 120) for p in (2, 1)] + ([(None, "new null", 5)] if null_key else [])
    older = spark.createDataFrame(old, "k long, v string").withColumn("p", F.lit(9))
    newer = spark.createDataFrame(new, "k long, v string, p int")
    name = M.save_snapshot(older, "k", buckets=4)
    got = M.merge_into_snapshot(spark, newer, name, "k", ["p"])
    want = M.keep_first(M.union_all(newer, older), "k", ["p"])
    key = lambda r: str(r)
    assert sorted(got.collect(), key=key) == sorted(want.select(*got.columns).collect(), key=key)
    again = M.save_snapshot(got, "k", buckets=4)  # the result is the next older table
    assert spark.table(again).count() == 121


def test_merge_leaves_the_older_rows_where_they_lie(spark):
    """Without broadcasts the only exchanges are those of the newer rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        name = M.save_snapshot(spark.range(1000).selectExpr("id AS k", "id AS v"), "k", buckets=8)
        newer = spark.range(990, 1100).selectExpr("id AS k", "-id AS v", "0 AS p")
        older = spark.table(name)
        got = M.merge_into_snapshot(spark, newer.select("k", "v"), name, "k", ["v"])
        plan = plan_of(got)
        scan = plan[plan.index("SortMergeJoin"):]
        old_side = scan[: scan.index("Scan parquet") if "Scan parquet" in scan else scan.index("FileScan")]
        assert "Exchange" not in old_side and "Bucketed: true" in plan
        assert got.count() == 1100 and older.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# ---------------------------------------------------------------- card


def test_card_takes_the_first_column_with_tags(spark):
    df = spark.createDataFrame([(None, "['x', 'y']", "a"), ("[]", "['x']", "b"), (None, None, "b")], "tags string, genres string, category string")
    assert [tuple(r) for r in TG.dataset_card(df, 2).collect()] == [(3, "genres", "x (2), y (1)")]
    assert [tuple(r) for r in TG.dataset_card(df.select("category", "tags"), 1).collect()] == [(3, "category", "b (2)")]
    assert [tuple(r) for r in TG.dataset_card(df.select("tags")).collect()] == [(3, None, "N/A")]
    assert [tuple(r) for r in TG.dataset_card(df.select(F.lit(1).alias("x"))).collect()] == [(3, None, "N/A")]
    assert [tuple(r) for r in TG.dataset_card(df.limit(0)).collect()] == [(0, None, "N/A")]


# ---------------------------------------------------------------- quantiles of columns


@pytest.mark.parametrize(("sketch_k", "final_rows"), [(8, 5), (1600, 100_000)])
def test_column_quantiles_match_numpy(spark, sketch_k, final_rows):
    """Ties, wide ranges, infinities and an empty column; small sketches err and are corrected by the counts."""
    r = np.random.default_rng(8)
    n = 400
    cols = {"a": r.normal(0, 1e5, n), "b": r.integers(0, 4, n).astype(float), "c": np.r_[r.normal(size=n - 2), -1e300, 1e300],
            "d": np.r_[[-math.inf] * 3, r.normal(size=n - 3)]}
    rows = [tuple(float(cols[c][i]) for c in cols) + (None,) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(3)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = column_quantiles(df, ["a", "b", "c", "d", "e"], probs, ["avg({c})"], final_rows, sketch_k)
    for g, c in zip(got, cols, strict=False):
        want = [np.percentile(cols[c], 100 * p) if c != "d" or p > 0.1 else -math.inf for p in probs]
        assert g["q"] == pytest.approx(want, rel=1e-12) and g["n"] == n and g["max"] == cols[c].max()
    assert got[0]["more"] == [pytest.approx(cols["a"].mean())] and got[4]["q"] is None and got[4]["n"] == 0


def test_box_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert D.box_summary(df, "v").collect() == []
    one = D.box_summary(spark.createDataFrame([(2.5,)], "v double"), "v").first()
    assert one.n == 1 and one["min"] == one.median == one["max"] == one.lower_whisker == 2.5 and one.n_outliers == 0


# ---------------------------------------------------------------- cells and key sketches


def test_series_of_cells_reads_its_source_once(spark, tmp_path):
    from vitrine.operators import aggregates as A
    from vitrine.operators import series as R
    rows = [(2000 + i % 4, "abc"[i % 3], float(i)) for i in range(60) if not (i % 4 == 1 and i % 3 == 2)] + [(None, "a", 1.0), (2001, None, 1.0)]
    df = spark.createDataFrame(rows, "y int, c string, v double")
    cells = R.year_cells(df, "y", "c", "v")
    top = [r[0] for r in A.top_categories(df, "c", 2).collect()]
    assert R.cell_categories(cells, "c", 2) == top
    for value, old in (("count", A.counts_per_year(df, "y", "c", selected=top)), ("sum", A.sum_per_year(df, "y", "c", "v", selected=top))):
        want = R.yearly_series(old, "y", "c", value, 1999, 2004, requested=top, variant=value)
        got = R.series_of_cells(cells, "y", "c", value, 1999, 2004, default_k=2)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    holes = R.series_of_cells(cells, "y", "c", "count", 1999, 2004, requested=["c"]).where("y = 2001").first()
    assert holes["count"] == 0  # no other requested category has that year
    assert [r["count"] for r in R.series_of_cells(cells, "y", "c", "count", 1999, 2004, requested=["c", "a"]).where("y = 2001 AND c = 'c'").collect()] == [None]


def test_key_sketches_merge_across_snapshots(spark):
    """Within 2 % of the exact number, for one table and for the union of overlapping ones."""
    from vitrine.operators import aggregates as A
    a, b = spark.range(0, 60_000), spark.range(40_000, 100_000)
    both = A.key_sketch(a, "id").unionByName(A.key_sketch(b, "id"))
    got = A.distinct_of_sketches(both).first()
    assert got.n_rows == 120_000 and abs(got.n_distinct - 100_000) < 2_000
    near = A.shape_and_distinct(a, "id", exact=False).first()
    assert near.n_rows == 60_000 and abs(near.n_distinct - 60_000) < 1_200
    assert A.shape_and_distinct(a, "id").first().n_distinct == 60_000
    assert tuple(A.distinct_of_sketches(both.limit(0)).first()) == (0, 0)


def test_bindings_reach_the_rules_they_name(spark):
    """The fixture rows of the registered queries hold a hole, an empty sum, a missing mean and like keys."""
    from vitrine.plans import catalog
    sf = "/root/testdata/sf0.001"
    series = catalog.QUERIES["orders_yearly_series_with_hole"](spark, sf).collect()
    assert {r.o_year for r in series if r["count"] is None} == {1996}
    totals = catalog.QUERIES["totalprice_per_year_without_values"](spark, sf).collect()
    assert [(r.o_year, r.o_orderpriority) for r in totals if r.total == 0] == [(1997, "1-URGENT")]
    means = catalog.QUERIES["mean_price_by_priority_nulls_last"](spark, sf).collect()
    assert means[-1].o_totalprice is None and None not in [r.o_totalprice for r in means[:-1]]
