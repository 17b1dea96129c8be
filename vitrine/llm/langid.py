"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The likelihood of a word is the sum over all its segmentations into pieces, by a
forward pass over the lattice of pieces; training is expectation-maximisation with
the matching backward pass.  Pieces do not cross word ends, so a text's log
likelihood is the sum of its words', and a word is scored once per worker.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import bounded_sample, fields, fold, slices
from vitrine.session import reliable_checkpoint

_LETTERS = re.compile(r"[^\W\d_]+")
#: Words up to this long are summed as they are; longer ones would underflow and are summed as logarithms.
_PLAIN_CHARS = 32
#: Characters of the words whose lattices are held at once.
_BATCH_CHARS = 200_000


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, whole; number signs such as a half or a Roman two are none."""
    found = _LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]


def load_pieces(vocabulary: str) -> dict[str, int]:
    """Piece -> id of a public sentencepiece vocabulary; '▁' marks a word's start."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
    return {
        model.id_to_piece(i): i
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    }


@dataclass
class Lattice:
    """Edges of many words' segmentation lattices, sorted by (end, word) or (start, word)."""

    words: int
    length: np.ndarray  # of each word, in characters with its start mark
    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray


def lattice(words: list[str], pieces: dict[str, int], unknown: int = 0) -> Lattice:
    """All pieces inside each word; a character that is no piece is an edge of the unknown id."""
    longest = max(map(len, pieces), default=1)
    out = array("q")
    length = np.empty(len(words), np.int64)
    get = pieces.get
    for k, word in enumerate(words):
        marked = "▁" + word
        n = length[k] = len(marked)
        for i in range(n):
            out.extend((k, i, i + 1, get(marked[i], unknown)))
            for j in range(i + 2, min(n, i + longest) + 1):
                if (p := get(marked[i:j])) is not None:
                    out.extend((k, i, j, p))
    edges = np.frombuffer(out, np.int64).reshape(-1, 4) if len(out) else np.empty((0, 4), np.int64)
    return Lattice(len(words), length, *edges.T)


def _sweep(lat: Lattice, prob: np.ndarray, backward: bool = False) -> np.ndarray:
    """Log of the sums over segmentations of every prefix (or suffix): words x positions x languages.

    Short words are summed as they are, batches with longer ones as logarithms: the same sums.
    """
    width = int(lat.length.max(initial=0)) + 1
    logs = width > _PLAIN_CHARS + 2
    sums = np.full((lat.words, width, prob.shape[1]), -np.inf if logs else 0.0)
    edge = np.log(prob) if logs else prob
    into, out_of = (lat.start, lat.end) if backward else (lat.end, lat.start)
    rows = np.arange(lat.words)
    sums[rows, lat.length if backward else 0] = 0.0 if logs else 1.0
    order = np.lexsort((lat.word, into))
    bounds = np.searchsorted(into[order], np.arange(width + 1))
    positions = range(width - 2, -1, -1) if backward else range(1, width)
    for at in positions:
        e = order[bounds[at] : bounds[at + 1]]
        if not len(e):
            continue
        w = lat.word[e]
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        if logs:
            sums[w[first], at] = np.logaddexp.reduceat(sums[w, out_of[e]] + edge[lat.piece[e]], first, axis=0)
        else:
            sums[w[first], at] += np.add.reduceat(sums[w, out_of[e]] * edge[lat.piece[e]], first, axis=0)
    if logs:
        return sums
    with np.errstate(divide="ignore"):  # places after a word's end
        return np.log(sums)


def _batches(words: list[str]) -> Iterator[list[int]]:
    """Places of the words in batches of like lengths: at most ``_BATCH_CHARS`` cells, at least one word."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        stop = at + 1
        plain = len(words[order[at]]) <= _PLAIN_CHARS
        while stop < len(order):
            size = len(words[order[stop]])
            if (size + 2) * (stop + 1 - at) > _BATCH_CHARS or (size <= _PLAIN_CHARS) != plain:
                break
            stop += 1
        yield order[at:stop]
        at = stop


def log_likelihood(words: list[str], pieces: dict[str, int], prob: np.ndarray) -> np.ndarray:
    """words x languages: log of the sum over all segmentations."""
    out = np.empty((len(words), prob.shape[1]), np.float64)
    for places in _batches(words):
        lat = lattice([words[i] for i in places], pieces)
        out[places] = _sweep(lat, prob)[np.arange(lat.words), lat.length]
    return out


@dataclass
class Model:
    languages: list[str]
    prob: np.ndarray  # piece x language
    prior: np.ndarray  # log share of each language
    vocabulary: str


def expected(words: list[str], n: np.ndarray, pieces: dict[str, int], prob: np.ndarray) -> np.ndarray:
    """Expected uses of every piece (piece x language) in ``words``, which occur ``n`` (words x languages) times,
    over all segmentations."""
    out = np.zeros_like(prob)
    for places in _batches(words):
        lat = lattice([words[i] for i in places], pieces)
        forward, backward = _sweep(lat, prob), _sweep(lat, prob, backward=True)
        total = forward[np.arange(lat.words), lat.length]
        seen = forward[lat.word, lat.start] + np.log(prob)[lat.piece] + backward[lat.word, lat.end] - total[lat.word]
        seen = np.exp(seen) * n[places][lat.word]
        for c in range(prob.shape[1]):
            out[:, c] += np.bincount(lat.piece, seen[:, c], len(prob))
    return out


def train(
    docs: DataFrame, sample_docs: int = 2000, vocabulary: str = "piece_bpe_32k.model", rounds: int = 4, smooth: float = 0.1
) -> Model:
    """Fit on word counts of at most ``sample_docs`` distinct rows of ``docs`` (doc_id, text, lang) with a language and a text.

    The counts stay distributed: a round of expectation-maximisation sends the probabilities out and
    gets back sums per piece and language, so the driver holds the vocabulary, no text.
    """
    sample = bounded_sample(docs.select("doc_id", "text", "lang").where("lang is not null and text is not null"), sample_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            pairs = Counter((lang, w) for text, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) for w in words_of(text))
            cols = list(zip(*pairs, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(pairs.values(), pa.int64())], ["lang", "word", "n"])

    counts = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return fit(reliable_checkpoint(counts, "word-counts"), vocabulary, rounds, smooth)


def fit(counts: DataFrame, vocabulary: str, rounds: int = 4, smooth: float = 0.1) -> Model:
    """(lang, word, n) -> piece probabilities by expectation-maximisation over all segmentations."""
    size = max(load_pieces(vocabulary).values()) + 1
    mass = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(mass)
    prob = np.full((size, len(languages)), 1.0 / size)
    spread = F.pmod(F.xxhash64("word"), F.lit(counts.sparkSession.sparkContext.defaultParallelism))

    def piece_sums(sent: Broadcast) -> Callable[[pa.Table], pa.Table]:
        def sums(part: pa.Table) -> pa.Table:
            words, code = np.unique(part["word"].to_numpy(), return_inverse=True)
            column = {lang: i for i, lang in enumerate(languages)}
            n = np.zeros((len(words), len(languages)))
            np.add.at(n, (code, [column[x] for x in part["lang"].to_pylist()]), part["n"].to_numpy())
            uses = expected(words.tolist(), n, load_pieces(vocabulary), sent.value)
            piece, lang = np.nonzero(uses)
            return pa.table({"piece": pa.array(piece, pa.int64()), "lang": pa.array(lang, pa.int64()), "uses": pa.array(uses[piece, lang])})

        return sums

    for _ in range(rounds if languages else 0):
        sent = counts.sparkSession.sparkContext.broadcast(prob)  # pieces x languages
        found = counts.groupBy(spread).applyInArrow(piece_sums(sent), "piece long, lang long, uses double")
        found = found.groupBy("piece", "lang").agg(F.sum("uses").alias("uses"))
        found = found.toArrow()
        uses = np.full_like(prob, smooth)
        uses[found["piece"].to_numpy(), found["lang"].to_numpy()] += found["uses"].to_numpy()
        prob = uses / uses.sum(axis=0)
        sent.unpersist()
    share = np.array([mass[x] for x in languages], float)
    return Model(languages, prob, np.log(share / share.sum()) if languages else share, vocabulary)


class Scorer:
    """A model with the words it has scored so far; at most ``remember`` of them."""

    def __init__(self, model: Model, remember: int = 400_000) -> None:
        self.model, self.remember = model, remember
        self.pieces = load_pieces(model.vocabulary)
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.empty((1024, len(self.model.languages)), np.float32)

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.row]
        if not new:
            return
        at = len(self.row)
        while len(self.table) < at + len(new):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[at : at + len(new)] = log_likelihood(new, self.pieces, self.model.prob)
        self.row.update(zip(new, range(at, at + len(new)), strict=True))

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior for each text; ``und`` and 0 without letters or languages."""
        pred, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.model.languages:
            return pred, score
        if len(self.row) > self.remember:
            self._forget()
        found = [words_of(t) if t else [] for t in texts]
        self._learn(set().union(*found))
        full = [i for i, w in enumerate(found) if w]
        if not full:
            return pred, score
        rows = np.fromiter((self.row[w] for i in full for w in found[i]), np.int64)
        starts = np.cumsum([0] + [len(found[i]) for i in full[:-1]])
        total = np.add.reduceat(self.table[rows].astype(np.float64), starts, axis=0) + self.model.prior
        best = total.argmax(axis=1)
        score[full] = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for i, b in zip(full, best, strict=True):
            pred[i] = self.model.languages[b]
        return pred, score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> doc_id, lang_pred, score: every row of ``docs``, from the whole text alone.

    NULL texts and texts without a letter are ``und`` with score 0, as is everything
    when nothing was learned.  Repeated rows are scored each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fields(model))  # pieces x languages: bounded by the vocabulary

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*sent.value))
        for b in slices(batches, limit=2_000_000):
            pred, score = scorer.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, **training) -> DataFrame:
    """Learn from the folds other than ``held_out``, predict all rows: doc_id, held_out, lang_pred, score."""
    model = train(docs.where(fold("doc_id", folds) != held_out), **training)
    return predict(docs, model).select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "lang_pred", "score")
