"""Trained operators: held-out accuracy, small exact cases, odd rows; and the pipeline."""

import math
import os
import subprocess
import sys

import numpy as np
import pytest
from llm_rows import CLASH, SF_MID, SF_SMALL, make_docs, none, odd  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from vitrine.llm import langid, quality, toxicity
from vitrine.llm.common import bounded_sample
from vitrine.llm.queries import queries

# language


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang", "text")
    rows = queries()["op2_language_id"](spark, SF_MID).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_forward_sums_all_segmentations():
    pieces = {"\u2581": 1, "a": 2, "b": 3, "\u2581a": 4, "ab": 5, "\u2581ab": 6}
    prob = np.array([[0.01], [0.1], [0.2], [0.3], [0.15], [0.05], [0.04]])
    # _ a b | _a b | _ ab | _ab
    want = 0.1 * 0.2 * 0.3 + 0.15 * 0.3 + 0.1 * 0.05 + 0.04
    got = langid.log_likelihood(["ab", "c"], pieces, prob)
    assert got[0, 0] == pytest.approx(math.log(want)) and got[1, 0] == pytest.approx(math.log(0.1 * 0.01))


def _segmentations(word, pieces):
    """All ways to cut the marked word into pieces; single characters may be unknown."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces or n == 1:
            for rest in _segmentations(word[n:], pieces):
                yield [pieces.get(word[:n], 0), *rest]


def test_expected_uses_against_enumeration():
    """A round of expectation-maximisation counts every piece in every segmentation by its share."""
    pieces = {"\u2581": 1, "a": 2, "b": 3, "\u2581a": 4, "ab": 5, "\u2581ab": 6, "aba": 7}
    prob = np.random.default_rng(1).uniform(0.01, 0.2, (8, 2))
    words, n = ["ab", "abab", "cab", "a"], np.array([[1, 2], [3, 0], [0.5, 1], [2, 2]], float)
    want = np.zeros_like(prob)
    for w, k in zip(words, n, strict=True):
        ways = list(_segmentations("\u2581" + w, pieces))
        p = np.array([np.prod(prob[s], axis=0) for s in ways])
        assert langid.log_likelihood([w], pieces, prob)[0] == pytest.approx(np.log(p.sum(axis=0)))
        for s, share in zip(ways, p / p.sum(axis=0), strict=True):
            for piece in s:
                want[piece] += share * k
    assert langid.expected(words, n, pieces, prob) == pytest.approx(want)


def test_long_words_are_summed_over_all_segmentations():
    """Words beyond 32 letters, also by far, have the sum that a plain recurrence with scaling gives."""
    pieces = {"\u2581": 1, "a": 2, "b": 3, "\u2581a": 4, "ab": 5, "bab" * 7: 6}
    prob = np.array([[1e-6], [0.01], [0.02], [0.03], [0.015], [0.005], [0.04]])
    for size in (31, 32, 33, 40, 5000):
        word = ("ab" * size)[:size]
        marked, sums, log = "\u2581" + word, [1.0], 0.0
        for end in range(1, len(marked) + 1):
            total = sum(sums[-k] * prob[pieces.get(marked[end - k : end], 0), 0] for k in range(1, min(21, end) + 1) if k == 1 or marked[end - k : end] in pieces)
            log += math.log(total)
            sums = [s / total for s in sums[-21:]] + [1.0]
        assert langid.log_likelihood([word, "a"], pieces, prob)[0, 0] == pytest.approx(log, rel=1e-9)
    n = np.array([[2.0]])
    uses = langid.expected(["ab" * 40], n, pieces, prob)
    lengths = {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 21}
    assert sum(uses[i, 0] * k for i, k in lengths.items()) == pytest.approx(2 * 81)


def test_texts_without_a_letter_have_no_language(spark, make_docs):
    model = langid.train(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    docs = make_docs([(1, "\u00bd \u00b2 \u2167 12 _"), (2, "\u00bd x"), (3, "the\u00b2other"), (4, "a" * 300_000)])
    rows = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert rows[1].lang_pred == "und" and rows[1].score == 0.0
    assert "und" not in {rows[i].lang_pred for i in (2, 3, 4)} and all(0 < rows[i].score <= 1 for i in (2, 3, 4))
    assert langid.words_of("the\u00b2other") == ["the", "other"]


def test_language_odd_rows(odd, none):
    rows = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert rows[3].lang_pred == rows[4].lang_pred == rows[5].lang_pred == rows[7].lang_pred == "und"
    assert rows[8].lang_pred in ("en", "de", "fr") and 0 <= rows[8].score <= 1
    assert langid.identify(odd).count() == 12 and langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_ignores_what_it_may_not_see(spark, odd):
    model = langid.train(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    a = langid.predict(odd, model).drop("doc_id").collect()
    b = langid.predict(odd.withColumn("doc_id", F.lit(0).cast("long")).withColumn("lang", F.lit("zz")), model).drop("doc_id").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


# toxicity


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = queries()["op10_toxicity"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.toxic for r in rows])
    assert len(rows) > 300 and right > 0.97
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(4)
    lengths = np.array([3, 0, 1, 4])
    emission, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    got = toxicity.marginal_logits(emission, lengths, trans)
    at = 0
    for n in lengths:
        mass = np.zeros((n, 2))
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            s = sum(emission[at + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1))
            for i in range(n):
                mass[i, y[i]] += math.exp(s)
        if n:
            assert np.allclose(np.log(mass[:, 1] / mass[:, 0]), got[at : at + n])
        at += n


def test_toxic_spans_point_at_the_words(spark, make_docs):
    rng = np.random.default_rng(1)
    plain = [f"w{''.join(chr(97 + c) for c in rng.integers(0, 26, 4))}" for _ in range(300)]
    docs, labels = [], []
    for i in range(400):
        ws = list(rng.choice(plain, 30))
        if i % 4 == 0:
            ws[int(rng.integers(30))] = str(rng.choice(["grobkerl", "mistding"]))
        docs.append((i, " ".join(ws)))
        labels.append((i, int(i % 4 == 0)))
    frame, marks = make_docs(docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.detect(frame, marks).collect()
    texts = dict(docs)
    for r in rows:
        assert r.predicted == (r.doc_id % 4 == 0)
        assert {texts[r.doc_id][s.start : s.end] for s in r.spans} <= {"grobkerl", "mistding"}
        assert bool(r.spans) == bool(r.predicted)


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (7, None), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.detect(odd, labels).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.detect(none, labels).count() == 0
    assert toxicity.detect(odd, labels.limit(0)).count() == 12


def test_every_tagged_window_trains(monkeypatch):
    docs = [[f"w{i % 7}"] * 16 + ["grobkerl" if i % 2 else "haus"] for i in range(60)]
    seen = []
    real = toxicity.train_chain
    monkeypatch.setattr(toxicity, "train_chain", lambda ws, tags: seen.append(tags) or real(ws, tags, rounds=1))
    toxicity.fit(docs, [i % 2 for i in range(60)], most_windows=10)
    assert sum(any(t) for t in seen[0]) == 30 and 10 <= sum(not any(t) for t in seen[0]) <= 15


def test_sample_is_bounded_where_one_id_has_many_texts(spark, make_docs, monkeypatch):
    docs = make_docs([(0, f"text {i}") for i in range(3_000)] + [(i, f"other {i}") for i in range(1, 31)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(31)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda ws, ys: seen.append(ws))
    toxicity.train(docs, labels, sample_docs=100)
    assert 100 < len(seen[0]) < 300 and sum(ws[0] == "other" for ws in seen[0]) == 30


# quality


def test_long_words_count_whole():
    word = "A" * 2_000 + "b" * 8_000
    _, stats = quality.describe(word, quality.Shapes())
    assert stats[0] == 0.2 and stats[6] == 1.0 and stats[5] == 10_000
    _, stats = quality.describe(f"{'#' * 3_000}{'x' * 6_000} Ab {'c' * 1_023}", quality.Shapes())
    assert stats[0] == 1 / 7_025 and stats[1] == 3_000 / 10_025 and stats[6] == 7_025 / 10_025


def test_quality_against_labels_it_never_sees(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = queries()["op1_quality"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert np.mean([r.predicted for r in good]) > 0.995 and np.mean([r.predicted for r in bad]) < 0.1


def test_label_model_learns_who_is_right():
    rng = np.random.default_rng(0)
    patterns = {}
    for _ in range(5000):
        good = rng.random() < 0.8
        votes = []
        for k in range(10):
            if k < 7:
                votes.append(0 if not good and rng.random() < 0.4 else 2)
            else:
                votes.append(1 if rng.random() < (0.95 if good else 0.2 * (k - 6)) else 2)
        patterns[tuple(votes)] = patterns.get(tuple(votes), 0) + 1
    posterior, accuracy, prior = quality.label_model(patterns)
    assert abs(prior - 0.8) < 0.05 and accuracy["capitals"][0] > 0.95
    assert accuracy["plain case"][1] > accuracy["plain flow"][1]
    assert posterior[(2,) * 7 + (1,) * 3] > 0.9 > 0.1 > posterior[(0, 0) + (2,) * 8]


def test_quality_odd_rows(odd, none):
    rows = {r.doc_id: r for r in quality.classify(odd).collect()}
    assert quality.classify(odd).count() == 12 and quality.classify(none).count() == 0
    assert [rows[i].quality_kept for i in (3, 4, 5)] == [0, 0, 0] and rows[1]["score"] == "clash"


# pipeline and samples


def test_bounded_sample_is_bounded_and_repeats(spark):
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id")
    a = {r[0] for r in bounded_sample(docs, 1000).collect()}
    assert a == {r[0] for r in bounded_sample(docs.repartition(7), 1000).collect()} and len(a) == 1000


@pytest.mark.parametrize("doc_id", ["1", "7", "NULL"])
def test_bounded_sample_of_one_id_is_not_empty(spark, doc_id):
    """Rows of one id are told apart by their other columns; copies count once, and few among many are found."""
    rows = spark.range(5000).selectExpr(f"cast({doc_id} as long) AS doc_id", "cast(id % 3000 AS string) AS text")
    got = bounded_sample(rows, 1000).collect()
    assert len(got) == len(set(got)) == 1000
    copies = spark.range(5000).selectExpr(f"cast({doc_id} as long) AS doc_id", "cast(id % 3 AS string) AS text")
    assert sorted(r.text for r in bounded_sample(copies, 1000).collect()) == ["0", "1", "2"]
    assert bounded_sample(rows.limit(0), 10).count() == 0


def test_quality_is_learnt_where_ids_are_null(spark):
    """Junk is rejected whether ids are distinct, equal or NULL."""
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").join(spark.read.parquet(f"{SF_MID}/labels.parquet"), "doc_id")
    for doc_id in ("doc_id", "7L", "cast(NULL AS long)"):
        rows = quality.classify(docs.selectExpr(f"{doc_id} AS doc_id", "text", "quality"), sample_docs=200).collect()
        good = [r.quality_kept for r in rows if r.quality == 1]
        bad = [r.quality_kept for r in rows if r.quality == 0]
        assert np.mean(good) > 0.95 and np.mean(bad) < 0.2


def test_pipeline_stages_keep_their_contract(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, texts, SF_SMALL).cache()
        assert out.columns == docs.columns, name
        if name != "mix_sources":
            assert out.select("doc_id").exceptAll(texts.select("doc_id")).count() == 0
            assert out.count() <= texts.count()
        if name == "exact_dedup":
            norm = F.translate("text", " \t\n\x0b\x0c\r", "")
            assert out.select(norm).distinct().count() == out.count() == texts.select(norm).distinct().count()
        texts = out
    plan = corpus_pipeline.STAGES[-1][1](spark, texts, SF_SMALL)
    assert plan.where("piece = 0").count() == texts.count()
    assert 0 < texts.select("doc_id").distinct().count() <= before


def test_pipeline_of_odd_rows(spark, odd, none):
    """Stages keep all columns, whatever they are called, and do to odd rows what their docstrings say."""
    docs, seen = odd, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.columns == odd.columns, name
        docs = docs.cache()
        rows = docs.collect()
        assert all(r[c] == "clash" for r in rows for c in CLASH), name
        seen[name] = rows
    blank = {3, 4, 5, None}
    ids = {name: [r.doc_id for r in rows] for name, rows in seen.items()}
    assert not {r.doc_id for r in seen["quality_classifier"] if not (r.text or "").strip()}
    assert len(ids["exact_dedup"]) == len({r.text and "".join(r.text.split()) for r in seen["exact_dedup"]})
    assert set(ids["mix_sources"]) <= set(ids["simhash_near_dedup"]) <= set(ids["exact_dedup"]) <= set(ids["quality_classifier"])
    # Each stage by itself on all odd rows.
    stages = dict(corpus_pipeline.STAGES)
    once = stages["exact_dedup"](spark, odd, SF_SMALL).collect()
    assert len(once) == 7 and sum(r.doc_id in blank and not (r.text or "").strip() for r in once) == 1
    near = stages["simhash_near_dedup"](spark, odd, SF_SMALL).collect()
    assert len(near) < 12 and sum(not (r.text or "").strip() for r in near) == 1
    mixed = stages["mix_sources"](spark, odd, SF_SMALL)
    assert mixed.columns == odd.columns and all(r[c] == "clash" for r in mixed.collect() for c in CLASH)
    plan = stages["best_fit_packing"](spark, odd, SF_SMALL)
    assert plan.where("piece = 0").count() == 12
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF_SMALL).count() == 0, name


def test_pipeline_run_leaves_only_what_its_result_reads(spark):
    from vitrine.session import scratch_mark

    mark = scratch_mark()
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.count() > 0
    assert scratch_mark() - mark <= 3  # the last stage's input and the packing's own tables


_EVERY_QUERY = """
import sys
sys.path.insert(0, sys.argv[1])  # the driver's path, which workers do not share
import __spark_entry__ as E
from vitrine.session import build_session
spark = build_session("local[4]", shuffle_partitions=4)
def workers_lack_it(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("vitrine") is None] * b.num_rows)], ["ok"])
assert all(r.ok for r in spark.range(4).mapInArrow(workers_lack_it, "ok boolean").collect())
for name, query in E.queries().items():
    if name.startswith("op") or name == "pipeline":
        query(spark, sys.argv[2]).write.format("noop").mode("overwrite").save()
        print("ran", name)
"""


def test_queries_run_on_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", _EVERY_QUERY, root, SF_SMALL], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("ran ") == 14
