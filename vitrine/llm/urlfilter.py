"""URL filter: rules of hosts and paths first, a trained model for every other URL.

The model is a logistic regression on hashed character n-grams of host and path, fitted on a
small labelled URL table (Spark ML, a bounded number of coefficients).  n-grams, hashing,
scores and rules are column expressions: one pass over the URLs, no shuffle.
"""

from __future__ import annotations

import itertools
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of the hosts in the labelled URL table, which ``labelled_urls`` makes of them.
BLOCK_WORDS = """
    casino slots poker jackpot roulette bets betting odds win winner lucky free bonus prizes adult porn xxx x sex cams
    escort spam spammer farm seo cheap pills viagra meds replica ads ad banner popup track tracker click pixel malware
    virus phishing crack warez payday loans
""".split()
ALLOW_WORDS = """
    news city post weather open library history museum garden recipes home cooking university science today mathematics
    health hospital travel guide trains mountain theatre thinking thesaurus thunder fashion nation station table anthem
    worship friendship northern software docs chess club football orchestra town hall law review astronomy rivers birds
    painting school board economy dictionary photography bakery fire old maps research letters language teacher weaver
    street edition addition handbook tales earth winter windows farmer adventure freedom better
""".split()
SUBDOMAINS = ["", "www.", "m.", "blog."]
SUFFIXES = ["example.com", "example.net", "example.org"]
PATHS = ["", "/", "/en/{}", "/de/{}/", "/fr/{}.html", "/es/{}", "/{}/page?ref=x", "/archive/{}#top"]


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://`` (A-Z lower-cased) and the path; both empty for a NULL url or one without ``://``."""
    url, parts = F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(url, parts, 2)


def grams(host: Column, path: Column, sizes: Sequence[int] = (3, 4, 5)) -> Column:
    """Character n-grams of host and path, each marked by its part; digits count as one digit.

    A look-ahead takes the n-gram at every place in one scan, whatever the length.
    """

    def marked(mark: str, text: Column, n: int) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), lambda g: F.concat(F.lit(mark), g))

    plain = (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", path))
    parts = [marked(mark, F.regexp_replace(F.lower(text), "[0-9]", "0"), n) for mark, text in plain for n in sizes]
    return F.concat(*parts)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled URL table: url, label (1: block).

    A few thousand rows: every word as a host, alone and joined to two others of its kind, below
    every subdomain and suffix, so that neither those, nor hyphens, nor paths tell the labels apart.
    """
    rows = []
    for label, words in ((1, BLOCK_WORDS), (0, ALLOW_WORDS)):
        for i, word in enumerate(words):
            names = [word, f"{word}-{words[(i + 5) % len(words)]}", f"{words[(i + 11) % len(words)]}-{word}"]
            places = itertools.product(names, SUBDOMAINS, SUFFIXES)
            rows += [(f"https://{sub}{name}.{suffix}{PATHS[(i + j) % len(PATHS)].format(i + j)}", label) for j, (name, sub, suffix) in enumerate(places)]
    return spark.createDataFrame(rows, "url string, label int")


def train(labelled: DataFrame, features: int = 1 << 16, penalty: float = 0.001) -> PipelineModel:
    """(url, label) -> the fitted n-gram hasher and logistic regression.

    ``labelled`` is a small table, read in one partition so that sums have one order; rows
    with a NULL label are left out.  It needs both labels.
    """
    rows = labelled.where("label is not null").coalesce(1).select(F.col("label").cast("double").alias("label"), grams(*host_and_path(F.col("url"))).alias("grams"))
    hasher = HashingTF(inputCol="grams", outputCol="features", numFeatures=features, binary=True)
    model = LogisticRegression(regParam=penalty, standardization=False, maxIter=50).fit(hasher.transform(rows))
    return PipelineModel([hasher, model])


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(verdict, name) of the longest rule that fits, NULL if none does; of equally long ones the first given.

    ``rules`` is a list in the plan: up to some thousands.
    """
    found = F.lit(None).cast("struct<verdict:string,name:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):  # the longest is asked last and stands outermost
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.name).alias("name"))).otherwise(found)
    return found


def judge(pages: DataFrame, rules: Sequence[Rule], model: PipelineModel, id_col: str = "page_id", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``pages`` (id, url): the id, host, path, rule, verdict, score.

    ``verdict`` is that of the longest fitting rule, else ``block`` where the model's ``score``
    reaches ``threshold``, else ``allow``; rows with a rule are scored too.  A NULL url, or one
    without ``://``, has an empty host and path, fits no rule and gets the score of a URL
    without n-grams.  Repeated rows and ids are judged each by itself; other columns are not
    read; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("grams", grams(F.col("host"), F.col("path")))
    score = vector_to_array("probability")[1]
    return model.transform(rows).select(
        id_col,
        "host",
        "path",
        F.col("found.name").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.when(score >= threshold, "block").otherwise("allow")).alias("verdict"),
        score.alias("score"),
    )
