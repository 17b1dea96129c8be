"""Hard negatives, URL filter and Merkle manifest against plain Python."""

import hashlib
import math
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_rows import SF_SMALL, make_docs, none, odd  # noqa: F401
from vitrine.llm import hardneg, merkle, queries, urlfilter

# ---------------------------------------------------------------- hard negatives


def brute_negatives(rows, k=5, n=10):
    """rows (vec_id, label, ints) -> the expected rows."""
    out = []
    null_last = lambda i: (i is None, i or 0)
    for a, (aid, alabel, av) in enumerate(rows):
        if aid is None or aid % 100:
            continue
        score = [sum(x * y for x, y in zip(av, v)) for _, _, v in rows]
        order = sorted(range(len(rows)), key=lambda i: (-score[i], null_last(rows[i][0])))
        for p in [i for i in order if i != a and rows[i][1] == alabel][:k]:
            fit = [i for i in order if rows[i][1] != alabel and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:n]
            out += [(aid, rows[p][0], r, rows[i][0], score[p], score[i]) for r, i in enumerate(fit, 1)]
    return sorted(out, key=str)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>")
    return sorted(map(tuple, hardneg.mine(df, F.col("vec_id") % 100 == 0, **kw).collect()), key=str)


@pytest.mark.parametrize("spread", [3, 200, 10**5])
def test_negatives_match_brute_force(spark, spread):
    """Few values (many ties), usual ones, and ones whose products need more than a float; several blocks and shards."""
    r = random.Random(spread)
    rows = [(i * 4, r.choice([0, 0, 0, 1, 2]), [r.randint(-spread, spread) for _ in range(6)]) for i in range(500)]
    got = mined(spark, rows, members=4, block_values=8 * 6, shard_values=70 * 6, clusters=3)
    assert got and got == brute_negatives(rows)


def test_negatives_of_clustered_rows_stop_early(spark):
    """Near one direction the shared list ends walks long before its end, with the right rows."""
    r = np.random.default_rng(5)
    base = r.normal(size=(8, 16))
    rows = [(i, int(i % 8), [int(x) for x in 256 * (base[i % 8] + 0.02 * r.normal(size=16))]) for i in range(2000)]
    assert mined(spark, rows) == brute_negatives(rows)
    m = hardneg.Members(np.arange(4), np.zeros(4, np.int64), np.array([v for _, _, v in rows[:32:8]]), np.arange(4), np.full(4, -(2**62)), np.full(4, 2**62), 5, True)
    every = np.array([v for _, _, v in rows])
    bound = m.bounds(every, hardneg.lengths(every))
    got = (m.vectors / hardneg.lengths(m.vectors)[:, None]) @ every.T
    assert (got <= bound + 1e-6).all()
    worst = np.sort(got, axis=1)[:, -5]
    assert (bound >= worst.min()).sum() < len(rows) / 2


def test_negatives_of_odd_rows(spark):
    """NULLs and rows without finite numbers take no part; equal rows, repeated and NULL ids, zero, empty
    and longer vectors do; numbers beyond 2^53 stay exact."""
    big = 2**29
    rows = [(0, 1, [3, 4]), (0, 1, [3, 4]), (4, 1, [3, 4]), (5, 2, [1, 2]), (None, 2, [1, 2]), (6, 2, [2, 1, 7]), (7, 3, []),
            (100, 2, [0, 0]), (101, 2, [0, 0]), (8, 1, [0, 0]), (200, 5, [big + 1, big]), (201, 5, [big, big - 1]), (202, 6, [big // 2 + 1, 3]), (203, 6, [big // 2 + 1, 3])]
    assert mined(spark, rows) == brute_negatives(rows)
    out = spark.createDataFrame([(0, None, [1]), (100, 1, None), (1, 1, [None, 2]), (2, 2, [1])], "vec_id long, label int, vector array<long>")
    assert hardneg.mine(out, F.col("vec_id") % 100 == 0).collect() == []
    clash = spark.createDataFrame([(0, 1, [3]), (1, 1, [3]), (2, 2, [1])], "vec_id long, label int, vector array<long>")
    for name in ("row", "bucket", "near", "wish", "anchor", "score"):
        clash = clash.withColumn(name, F.lit("clash"))
    assert [tuple(r) for r in hardneg.mine(clash, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 2, 9, 3)]
    none_ = clash.limit(0)
    assert hardneg.mine(none_, F.col("vec_id") % 100 == 0).collect() == []


def test_negatives_query_reads_its_table(spark, tmp_path):
    nan, inf = math.nan, math.inf
    rows = [(i, i % 3, [math.sin(i * 7 + j) for j in range(5)]) for i in range(300)]
    rows += [(700, 1, [nan] * 5), (800, None, [0.5] * 5), (900, 1, None), (1000, 1, [None, 1.0]), (1100, 1, [inf, 1.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, queries.op11_hard_negatives(spark, str(tmp_path)).collect()), key=str)
    kept = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, lab, v in rows[:300]]
    assert got and got == brute_negatives(kept)


def test_scores_that_fit_no_long_raise():
    m = hardneg.Members(np.array([0]), np.array([1]), np.array([[2**40, 2**40]]), np.array([0]), np.array([0]), np.array([2**62]), 5, False)
    rows = {"row": np.array([1]), "label": np.array([2]), "id": np.array([1]), "no_id": np.array([False])}
    assert m.walk(rows, np.array([[2**20, 1]]), np.array([2.0**20]))[2].tolist() == [2**60 + 2**40]
    with pytest.raises(OverflowError):
        m.walk(rows, np.array([[2**40, 1]]), np.array([2.0**40]))


# ---------------------------------------------------------------- URL filter

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
URLS = [
    None, "", "nothing", "://", "a://", "http://A.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/1",
    "http://org", "http://org/", "http://x.org?/es/", "x://www.shop.COM/fr/a://b/de/", "y://com/de/", "y://com/de", "y://com/DE/", "http://\u00c9.com/fr/\u00e9\n/x", "z://h#a/b?c",
    "http://a.com:80/fr/", "http://u@example.org/es/", "two\nlines://Host.Com/de/1\n2?3", "http://a.org/b c\t/d",
]


def plain_judge(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fit = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return host, path, max(fit, key=lambda r: len(r[1] + r[2])) if fit else None


@pytest.fixture(scope="module")
def url_model(spark):
    return urlfilter.train(urlfilter.labelled_urls(spark))


def test_urls_are_split_and_ruled(spark, url_model):
    """Hosts, paths and rules of odd URLs; repeated rows, NULL ids and clashing columns change nothing."""
    pages = spark.createDataFrame([(i if i % 3 else None, u) for i, u in enumerate(URLS * 2)], "page_id long, url string")
    for name in ("host", "path", "rule", "found", "grams", "features", "probability", "verdict", "html", "label"):
        pages = pages.withColumn(name, F.lit("clash"))
    got = urlfilter.judge(pages, [urlfilter.Rule(*r) for r in RULES], url_model).collect()
    assert len(got) == 2 * len(URLS)
    want = []
    for i, u in enumerate(URLS * 2):
        host, path, rule = plain_judge(u)
        want.append((i if i % 3 else None, host, path, rule and rule[1] + rule[2], rule and rule[0]))
    key = lambda r: tuple(map(str, r[:4]))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert (g.page_id, g.host, g.path, g.rule) == w[:4] and g.verdict in ("allow", "block")
        assert g.verdict == (w[4] or ("block" if g.score >= 0.5 else "allow"))
    assert urlfilter.judge(pages.limit(0), [], url_model).collect() == []


def test_url_scores_follow_the_regression(spark, url_model):
    """The score is the logistic function of the distinct hashed n-grams' weights, and the labelled table is learnt."""
    rows = urlfilter.labelled_urls(spark).withColumnRenamed("label", "page_id")
    got = urlfilter.judge(rows, [], url_model).toPandas()
    assert ((got.score >= 0.5) == got.page_id).mean() > 0.99
    hasher, lr = url_model.stages
    urls = rows.limit(20).withColumn("page_id", F.monotonically_increasing_id())
    scores = {r.page_id: r.score for r in urlfilter.judge(urls, [], url_model).collect()}
    for r in urls.withColumn("grams", urlfilter.grams(*urlfilter.host_and_path(F.col("url")))).collect():
        z = lr.intercept + sum(lr.coefficients[i] for i in {hasher.indexOf(g) for g in r.grams})
        assert abs(1 / (1 + math.exp(-z)) - scores[r.page_id]) < 1e-9


@pytest.mark.parametrize("fold", range(2))
def test_url_model_on_words_it_has_not_seen_joined(spark, fold):
    """Hosts joined of two words, one in four held out: nearly all are told apart."""
    table = urlfilter.labelled_urls(spark)
    host = urlfilter.host_and_path(F.col("url"))[0]
    name = F.regexp_extract(host, r"([a-z]+-[a-z]+)\.example", 1)
    out = (name != "") & (F.crc32(name) % 4 == fold)
    model = urlfilter.train(table.where(~out))
    got = urlfilter.judge(table.where(out).withColumnRenamed("label", "page_id"), [], model).toPandas()
    assert len(got) > 200 and ((got.score >= 0.5) == got.page_id).mean() > 0.97


def test_grams_are_every_substring_and_take_linear_time(spark):
    df = spark.createDataFrame([("ab-1.c", "/x9/")], "h string, p string")
    got = set(df.select(urlfilter.grams(F.col("h"), F.col("p"), (3, 4))).first()[0])
    h, p = "^ab-0.c$", "/x0/"
    assert got == {f"h{h[i:i + n]}" for n in (3, 4) for i in range(len(h) - n + 1)} | {f"p{p[i:i + n]}" for n in (3, 4) for i in range(len(p) - n + 1)}
    long = spark.createDataFrame([("http://h.com/" + "abcd" * 250_000,)], "url string")
    began = time.time()
    assert long.select(F.size(urlfilter.grams(*urlfilter.host_and_path(F.col("url"))))).first()[0] > 2_900_000
    assert time.time() - began < 30


# ---------------------------------------------------------------- Merkle manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, arity=8):
    """documents rows as dicts -> sorted expected rows."""

    def leaf(r, text):
        value = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
        return H(*map(value, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
        return out

    def path(tree, i):
        for nodes in tree[:-1]:
            a = i // arity * arity
            yield nodes[a:i], nodes[i + 1 : a + arity]
            i //= arity

    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((leaf(r, r["text"]), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        groups[x].sort(key=lambda r: (r[1]["doc_id"] is not None, r[1]["doc_id"] or 0, r[0]))
    trees = [levels([h for h, _ in groups[x]]) for x in langs]
    top = levels([t[-1][0] for t in trees]) if trees else []
    out = []
    for k, x in enumerate(langs):
        for i, (h, r) in enumerate(groups[x]):
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = text.translate(LOWER)
            now, proof = leaf(r, text), []
            for left, right in [*path(trees[k], i), *path(top, k)]:
                now, proof = H(*left, now, *right), proof + left + right
            root = top[-1][0]
            out.append((r["doc_id"], h, trees[k][-1][0], root, H(*proof), now, now == root))
    return sorted(out, key=str)


def manifest(docs, **kw):
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = {"text": F.when(hit, low).otherwise(F.col("text"))}
    return sorted(map(tuple, merkle.manifest(merkle.leaves(docs, FIELDS, "doc_id", "lang", changed), **kw).collect()), key=str)


def test_manifest_query_matches_plain_python(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = sorted(map(tuple, queries.op13_merkle_manifest(spark, SF_SMALL).collect()), key=str)
    assert got == brute_manifest([r.asDict() for r in docs.collect()])
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("arity", [2, 8])
def test_manifest_of_odd_rows(odd, none, arity):  # noqa: F811
    """NULLs, repeated rows and ids, empty and long texts, extra columns; no rows."""
    rows = [{f: r[f] for f in FIELDS} for r in odd.collect()]
    for name in ("grp", "leaf", "seen", "id", "pos", "tree", "now_text"):
        odd = odd.withColumn(name, F.lit("clash"))
    assert manifest(odd, arity=arity) == brute_manifest(rows, arity)
    assert manifest(none, arity=arity) == []


@pytest.mark.parametrize(("langs", "n"), [(["en"], 1), (["en", None], 9), ([None], 65)])
def test_manifest_of_lone_and_full_runs(make_docs, langs, n):  # noqa: F811
    docs = make_docs([(i, f"Text {i}", langs[i % len(langs)], None) for i in range(n)])
    assert manifest(docs) == brute_manifest([r.asDict() for r in docs.collect()])


def test_manifest_of_many_groups(make_docs):  # noqa: F811
    """More groups than one run of subroots holds."""
    docs = make_docs([(i, "T", f"l{i % 23}" if i % 23 else None, "s") for i in range(200)])
    assert manifest(docs) == brute_manifest([r.asDict() for r in docs.collect()])
