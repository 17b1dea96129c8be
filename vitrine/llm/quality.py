"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Votes are counted by pattern over the whole corpus, and expectation-maximisation
on those counts estimates each labeller's accuracy and every pattern's posterior.
The posteriors of a bounded sample train a linear scorer over hashed features,
which then scores every document; no hand-made label is used.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.common import bounded_sample, fields, slices

_BITS = 16
LABELLERS = (
    "capitals", "symbols", "repeats", "variety", "wordless", "word length", "letters",
    "plain case", "plain marks", "plain flow",
)
#: Documents of fewer words tell nothing about repetition.
_FEW = 12


#: Longest word whose counts all fit the packed descriptor; a longer one's are taken apart from it.
_PACKED = 1023


def _counts(word: str) -> tuple[int, int, int, int]:
    """Letters, capitals, digits and symbols of a word."""
    letters = sum(map(str.isalpha, word))
    digits = sum(map(str.isdigit, word))
    symbols = len(word) - letters - digits - sum(word.count(c) for c in ".,'’;:?-()\"")
    return letters, sum(map(str.isupper, word)), digits, symbols


def _shape(word: str) -> int:
    """Descriptor of a word, packed: hash (16 bits), letters (10), capitals (10), symbols (10), characters (12)."""
    letters, capitals, digits, symbols = _counts(word)
    cased = "none" if not letters else "upper" if capitals == letters > 1 else "title" if capitals else "lower"
    core = len(word.rstrip(".,;:!?'\""))
    text = f"{cased} {min(letters, 12)} {min(digits, 4)} {min(max(symbols, 0), 4)} {word[core:][:3]}"
    code = zlib.crc32(text.encode("utf-8", "surrogatepass")) & 0xFFFF
    for value, bits in ((letters, 10), (capitals, 10), (max(symbols, 0), 10), (len(word), 12)):
        code = code << bits | min(value, (1 << bits) - 1)
    return code


class Shapes(dict):
    """Word -> descriptor, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        code = _shape(word)
        if len(word) <= 64:
            if len(self) >= 500_000:
                self.clear()
            self[word] = code
        return code


def describe(text: str, shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """(hashed descriptors of the words, statistics): shares of capitals among letters, of symbols among
    characters, of words equal to the one before, of distinct words, of words without a letter; mean
    letters of words with one; share of letters among characters; number of words."""
    words = text.split()
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.zeros(8)
    code = np.fromiter(map(shapes.__getitem__, words), np.int64, n)
    chars, symbols = code & 0xFFF, code >> 12 & 0x3FF
    capitals, letters = code >> 22 & 0x3FF, code >> 32 & 0x3FF
    for i in np.flatnonzero(chars > _PACKED):
        letters[i], capitals[i], _, found = _counts(words[i])
        symbols[i], chars[i] = max(found, 0), len(words[i])
    lettered = np.count_nonzero(letters)
    size, alpha = int(chars.sum()), int(letters.sum())
    return code >> 42, np.array(
        [
            int(capitals.sum()) / max(1, alpha),
            int(symbols.sum()) / size,
            sum(map(eq, words, words[1:])) / max(1, n - 1),
            len(set(words)) / n,
            1 - lettered / n,
            alpha / max(1, lettered),
            alpha / size,
            n,
        ]
    )


def votes(stats: np.ndarray) -> tuple[int, ...]:
    """One vote for each labeller: 1 good, 0 bad, 2 none.

    Seven look for one kind of junk each and are silent otherwise, since junk of one
    kind is normal in the others' eyes; the last three speak for a text that is plain
    in one respect.
    """
    capitals, symbols, repeats, variety, wordless, length, letters, n = stats
    if not n:
        return (2,) * len(LABELLERS)
    many = n >= _FEW
    variety = variety * max(1.0, np.sqrt(n / 200)) if many else 1.0
    repeats = repeats if many else 0.0
    wordless = wordless if many else 0.0
    bad = (
        capitals >= 0.4,
        symbols >= 0.06,
        repeats >= 0.3,
        variety <= 0.2,
        wordless >= 0.2,
        letters > 0 and not 2.0 <= length <= 14.0,
        many and letters <= 0.6,
    )
    good = (capitals <= 0.2 and letters >= 0.7, symbols <= 0.03 and wordless <= 0.1, repeats <= 0.1 and variety >= 0.3)
    return tuple(0 if v else 2 for v in bad) + tuple(1 if v else 2 for v in good)


def hashed(codes: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features: shares of word descriptors, and the binned statistics."""
    index, count = np.unique(codes, return_counts=True)
    bins = [f"{k}:{min(int(v * 20), 40)}" for k, v in enumerate(stats[:5])]
    bins += [f"5:{min(int(stats[5]), 20)}", f"6:{int(stats[6] * 10)}"]
    binned = [zlib.crc32(b.encode()) & 0xFFFF for b in bins] if stats[7] else []
    return np.concatenate([index, np.array(binned, np.int64)]), np.concatenate(
        [np.sqrt(count / max(1, len(codes))), np.full(len(binned), 0.5)]
    )


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    accuracy: dict[str, tuple[float, float]]  # labeller -> share right of its bad and of its good votes
    prior: float  # share of good documents


#: Where expectation-maximisation starts: chance of the votes bad, good, none of a labeller given the truth.
_START = np.array([[0.30, 0.05, 0.65], [0.02, 0.50, 0.48]])


def label_model(
    patterns: dict[tuple[int, ...], int], rounds: int = 100, prior: float = 0.8, strength: float = 20.0
) -> tuple[dict[tuple[int, ...], float], dict[str, tuple[float, float]], float]:
    """EM on vote patterns and their counts -> (posterior of good by pattern, accuracies, prior).

    A labeller has a chance of each vote, silence included, given the truth; it
    starts at ``_START``, which also weighs as ``strength`` documents throughout, so
    bad stays bad.  The accuracy of a labeller is the chance that it is right when it
    speaks: of bad votes, and of good votes (the prior's value where it never does).
    """
    keys = sorted(patterns)
    vote = np.array(keys, np.int64).reshape(len(keys), -1)
    n = np.array([patterns[k] for k in keys], float)
    judges = np.arange(vote.shape[1])
    chance = np.repeat(_START[:, None, :], vote.shape[1], axis=1)  # truth, labeller, vote
    for _ in range(rounds):
        log = np.log([1 - prior, prior])[:, None] + np.log(chance[:, judges, vote]).sum(axis=2)
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        share = np.stack([1 - good, good]) * n
        seen = np.stack([(share[:, :, None] * (vote == v)).sum(axis=1) for v in range(3)], axis=2)
        chance = seen + strength * _START[:, None, :]
        chance /= chance.sum(axis=2, keepdims=True)
        prior = float(np.clip(share[1].sum() / max(1.0, n.sum()), 0.05, 0.99))
    joint = chance * np.array([1 - prior, prior])[:, None, None]
    right = np.stack([joint[v, :, v] / joint[:, :, v].sum(axis=0) for v in (0, 1)], axis=1)
    return (
        dict(zip(keys, good.tolist(), strict=True)),
        {name: (float(r[0]), float(r[1])) for name, r in zip(LABELLERS, right, strict=False)},
        prior,
    )


def train_linear(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 80, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows with soft targets: full-batch AdaGrad."""
    weight, bias = np.zeros(1 << _BITS), 0.0
    if not rows:
        return weight, bias
    index = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    sq, sq_b = np.full(1 << _BITS, 1e-8), 1e-8
    for _ in range(rounds):
        off = target - 1 / (1 + np.exp(-(np.bincount(row, weight[index] * value, len(rows)) + bias)))
        grad = np.bincount(index, off[row] * value, len(weight)) - 1e-3 * weight
        sq += grad**2
        sq_b += off.sum() ** 2
        weight += rate * grad / np.sqrt(sq)
        bias += rate * off.sum() / np.sqrt(sq_b)
    return weight, bias


def vote_counts(docs: DataFrame) -> dict[tuple[int, ...], int]:
    """Vote patterns of all documents, counted: at most three to the number of labellers."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, seen = Shapes(), Counter()
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                seen["".join(map(str, votes(describe(text or "", shapes)[1])))] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["votes", "n"]
        )

    counted = docs.select("text").mapInArrow(of, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    return {tuple(map(int, r["votes"])): r["n"] for r in counted.collect()}


def train(docs: DataFrame, sample_docs: int = 5000) -> Model:
    """Label model from the votes of all rows, scorer from about ``sample_docs`` of them."""
    posterior, accuracy, prior = label_model(vote_counts(docs)) if docs.take(1) else ({}, {}, 0.5)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for b in slices(batches):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                codes, stats = describe(text or "", shapes)
                if not stats[7]:
                    continue
                index, value = hashed(codes, stats)
                rows.append((doc_id, index.tolist(), value.tolist(), "".join(map(str, votes(stats)))))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "index", "value", "votes"]
            )

    found = bounded_sample(docs.select("doc_id", "text"), sample_docs).mapInArrow(
        of, "doc_id long, index array<long>, value array<double>, votes string"
    ).toArrow().sort_by([("doc_id", "ascending"), ("votes", "ascending")])
    rows = [
        (np.array(i, np.int64), np.array(v)) for i, v in zip(found["index"].to_pylist(), found["value"].to_pylist(), strict=True)
    ]
    target = np.array([posterior[tuple(map(int, v))] for v in found["votes"].to_pylist()])
    weight, bias = train_linear(rows, target)
    return Model(weight, bias, accuracy, prior)


def _probabilities(texts: pa.Array, model: Model, shapes: Shapes) -> np.ndarray:
    p = np.zeros(len(texts))
    for k, text in enumerate(texts.to_pylist()):
        codes, stats = describe(text or "", shapes)
        if stats[7]:
            index, value = hashed(codes, stats)
            p[k] = 1 / (1 + np.exp(-float(np.clip(model.weight[index] @ value + model.bias, -500, 500))))
    return p


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> the columns of ``docs`` with quality_score (probability of good) and quality_kept (0 or 1).

    NULL, empty and blank texts are not kept, with score 0.  Every row is scored from
    its whole text; columns of ``docs`` named like an added one are replaced.  An empty
    table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fields(model))  # 2^16 weights

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, m = Shapes(), Model(*sent.value)
        for b in slices(batches):
            p = _probabilities(b.column(b.schema.get_field_index("text")), m, shapes)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                [*b.schema.names, "quality_score", "quality_kept"],
            )

    docs = docs.drop("quality_score", "quality_kept")
    added = [T.StructField("quality_score", T.DoubleType()), T.StructField("quality_kept", T.IntegerType())]
    return docs.mapInArrow(of, T.StructType([*docs.schema.fields, *added]))


def keep_good(docs: DataFrame, **training) -> DataFrame:
    """The rows of ``docs`` that a model trained on ``docs`` itself keeps, with all their columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(fields(train(docs, **training)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, m = Shapes(), Model(*sent.value)
        for b in slices(batches):
            p = _probabilities(b.column(b.schema.get_field_index("text")), m, shapes)
            yield b.filter(pa.array(p >= 0.5))

    return docs.mapInArrow(of, docs.schema)


def classify(docs: DataFrame, **training) -> DataFrame:
    """Train on ``docs`` without labels and score every row of it."""
    return score(docs, train(docs, **training))
