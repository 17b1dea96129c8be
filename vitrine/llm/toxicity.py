"""Toxic spans with a linear-chain conditional random field.

Tokens are labelled from document labels: the words, or beginnings of words, that
together explain the toxic documents and hardly occur in others are toxic there.  A
two-state chain over hashed word features is trained on windows of those tokens.
Forward-backward marginals of every token of a whole text give its offsets and,
aggregated and calibrated, the document's score.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import bounded_sample, fields, fold, slices
from vitrine.session import reliable_checkpoint

_LETTERS = re.compile(r"[^\W\d_]+")
_BITS = 18


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, one for each run of the text itself."""
    found = _LETTERS.findall(text)
    return " ".join(found).lower().split(" ") if found else found


def features(word: str) -> list[int]:
    """Hashed word, beginnings and end."""
    parts = ["w" + word, "p3" + word[:3], "p4" + word[:4], "p5" + word[:5], "s3" + word[-3:]]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & ((1 << _BITS) - 1) for p in parts]


@dataclass
class Model:
    weight: np.ndarray  # of a hashed feature, for state 1 against state 0
    bias: float
    trans: np.ndarray  # 2 x 2: from, to
    calibration: np.ndarray  # of 1, logit of the noisy-or, logit of the largest marginal


def _ahead(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log odds of the state after one step from log odds ``r``."""
    return np.logaddexp(t[0, 1], t[1, 1] + r) - np.logaddexp(t[0, 0], t[1, 0] + r)


def _back(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.logaddexp(t[1, 0], t[1, 1] + s) - np.logaddexp(t[0, 0], t[0, 1] + s)


def marginal_logits(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Log odds of state 1 for every token of sequences laid end to end.

    All sequences step together, longest first, so a step costs the sequences still running.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    alpha, beta = np.empty_like(emission), np.zeros_like(emission)
    longest = int(size[0]) if len(size) else 0
    running = np.searchsorted(-size, -np.arange(longest), "left")  # sequences longer than t
    at = starts[: running[0]] if longest else starts[:0]
    state = emission[at] if longest else emission[:0]
    alpha[at] = state
    for t in range(1, longest):
        at = starts[: running[t]] + t
        state = _ahead(state[: running[t]], trans) + emission[at]
        alpha[at] = state
    for t in range(longest - 2, -1, -1):
        at = starts[: running[t + 1]] + t
        beta[at] = _back(beta[at + 1] + emission[at + 1], trans)
    return alpha + beta


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def train_chain(windows: list[list[str]], tags: list[list[int]], rounds: int = 60, rate: float = 0.5, ridge: float = 1e-6) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights of the chain: full-batch AdaGrad ascent of the conditional likelihood."""
    lengths = np.array([len(w) for w in windows])
    vocabulary: dict[str, int] = {}
    token = np.array([vocabulary.setdefault(w, len(vocabulary)) for ws in windows for w in ws])
    feats = np.array([features(w) for w in vocabulary])
    gold = np.array([y for ys in tags for y in ys])
    starts = np.cumsum(lengths) - lengths
    last = starts + lengths - 1
    inner = np.setdiff1d(np.arange(len(token)), last)  # tokens with a following one
    weight, bias, trans = np.zeros(1 << _BITS), 0.0, np.zeros((2, 2))
    sq_w, sq_b, sq_t = np.full(1 << _BITS, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    pairs = gold[inner] * 2 + gold[inner + 1]
    gold_trans = np.bincount(pairs, minlength=4).reshape(2, 2)
    for _ in range(rounds):
        emission = (weight[feats].sum(axis=1) + bias)[token]
        logit = marginal_logits(emission, lengths, trans)
        off = gold - _sigmoid(logit)
        grad = np.zeros_like(weight)
        per_word = np.bincount(token, off, len(vocabulary))
        for c in range(feats.shape[1]):
            grad += np.bincount(feats[:, c], per_word, len(weight))
        # pair marginals: odds of the first token without what follows, and of the second likewise
        alpha = _prefix_logits(emission, lengths, trans)
        rest = logit - alpha  # beta
        a, b = alpha[inner], emission[inner + 1] + rest[inner + 1]
        joint = np.stack([np.zeros_like(a) + trans[0, 0], b + trans[0, 1], a + trans[1, 0], a + b + trans[1, 1]])
        joint = np.exp(joint - joint.max(axis=0))
        joint /= joint.sum(axis=0)
        grad_t = gold_trans - joint.sum(axis=1).reshape(2, 2)
        grad -= ridge * len(windows) * weight
        grad_b = off.sum()
        sq_w += grad**2
        sq_b += grad_b**2
        sq_t += grad_t**2
        weight += rate * grad / np.sqrt(sq_w)
        bias += rate * grad_b / np.sqrt(sq_b)
        trans = trans + rate * grad_t / np.sqrt(sq_t)
    return weight, bias, trans


def _prefix_logits(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    starts = np.cumsum(lengths) - lengths
    alpha = emission.copy()
    for t in range(1, int(lengths.max(initial=0))):
        at = starts[lengths > t] + t
        alpha[at] = _ahead(alpha[at - 1], trans) + emission[at]
    return alpha


def units(word: str) -> list[str]:
    """What may mark a word as toxic: the word itself, or a beginning it shares with others."""
    return [word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) > n)]


def toxic_units(docs: list[list[str]], labels: list[int], purity: float = 0.95) -> set[str]:
    """Words and beginnings that explain toxic documents.

    A candidate is found in toxic documents almost only, and in more of them than
    chance would give any one of all candidates.  The one in most toxic documents is
    taken first; a later one has to explain as many that are still unexplained.
    """
    places: dict[str, list[int]] = defaultdict(list)
    for i, ws in enumerate(docs):
        for u in {u for w in set(ws) for u in units(w)}:
            places[u].append(i)
    places = {u: at for u, at in places.items() if len(at) >= 3}
    label = np.array(labels)
    if not places or not 0 < label.sum() < len(label):
        return set()
    least = max(3.0, np.log(len(places)) / -np.log(label.mean()))
    pure = {}
    for u, at in places.items():
        hits = [i for i in at if label[i]]
        if len(hits) >= least and len(hits) >= purity * len(at):
            pure[u] = hits
    explained: set[int] = set()
    chosen: set[str] = set()
    for u in sorted(pure, key=lambda u: (-len(pure[u]), u.endswith("*"), u)):
        if sum(i not in explained for i in pure[u]) >= least:
            chosen.add(u)
            explained.update(pure[u])
    return chosen


def document_parts(logit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows (1, logit of the noisy-or, largest logit) of documents with tokens; empty ones get the floor."""
    out = np.tile([1.0, -20.0, -20.0], (len(lengths), 1))
    full = np.flatnonzero(lengths)
    if len(full):
        starts = (np.cumsum(lengths) - lengths)[full]
        logit = np.clip(logit, -20.0, 20.0)
        none = np.add.reduceat(-np.logaddexp(0.0, logit), starts)  # log of: no token is toxic
        out[full, 1] = np.clip(np.log(-np.expm1(none)) - none, -20.0, 20.0)
        out[full, 2] = np.maximum.reduceat(logit, starts)
    return out


def fit(
    docs: list[list[str]], labels: list[int], window: int = 16, most_windows: int = 30_000, seed: int = 5, clean_windows: int = 6
) -> Model:
    """Chain and calibration from tokenised documents and their labels (1 toxic, 0 not).

    The chain is trained on every window with a tagged token, and of the windows
    without one on ``clean_windows`` drawn from a document and about ``most_windows`` in all.
    """
    chosen = toxic_units(docs, labels)
    windows, tags = [], []
    n_clean = 0
    rng = np.random.default_rng(seed)
    for i in rng.permutation(len(docs)):
        ws, toxic = docs[i], labels[i]
        tagged = [int(bool(toxic) and not chosen.isdisjoint(units(w))) for w in ws]
        cuts = [a for a in range(0, len(ws), window)]
        keep = [a for a in cuts if any(tagged[a : a + window])]
        clean = [a for a in cuts if not any(tagged[a : a + window])]
        drawn = [clean[k] for k in rng.permutation(len(clean))[:clean_windows]]
        if n_clean < most_windows:
            keep += drawn
            n_clean += len(drawn)
        windows += [ws[a : a + window] for a in keep]
        tags += [tagged[a : a + window] for a in keep]
    base = float(np.clip(np.mean(labels) if labels else 0.0, 1e-3, 1 - 1e-3))
    flat = Model(np.zeros(1 << _BITS), 0.0, np.zeros((2, 2)), np.array([np.log(base / (1 - base)), 0.0, 0.0]))
    if not any(map(any, tags)):
        return flat
    model = Model(*train_chain(windows, tags), np.array([0.0, 0.0, 1.0]))
    memo: dict[str, float] = {}
    parts, y = [], []
    for at in range(0, len(docs), 200):
        some = docs[at : at + 200]
        parts.append(document_parts(*_chain(some, model, memo)))
        y += labels[at : at + 200]
    x, target, w = np.concatenate(parts) / [1.0, 10.0, 10.0], np.array(y, float), np.zeros(3)
    for _ in range(25):  # Newton steps of a ridge logistic regression
        p = _sigmoid(x @ w)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        w += np.linalg.solve(hess, x.T @ (target - p) - 0.1 * w)
    model.calibration = w / [1.0, 10.0, 10.0]
    return model


def _chain(docs: list[list[str]], model: Model, memo: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """(log odds of every token, token counts) of tokenised documents."""
    new = list(set().union(*docs).difference(memo))
    if new:
        memo.update(zip(new, (model.weight[np.array([features(w) for w in new])].sum(axis=1) + model.bias).tolist(), strict=True))
    lengths = np.array([len(ws) for ws in docs])
    emission = np.fromiter((memo[w] for ws in docs for w in ws), float, int(lengths.sum()))
    return marginal_logits(emission, lengths, model.trans), lengths


class Scorer:
    def __init__(self, model: Model, remember: int = 500_000) -> None:
        self.model, self.remember, self.memo = model, remember, {}

    def score(self, texts: list[str | None], spans: bool = False) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Document scores and, if asked for, code point offsets of tokens more likely toxic than not."""
        if len(self.memo) > self.remember:
            self.memo = {}
        docs = [words_of(t) if t else [] for t in texts]
        logit, lengths = _chain(docs, self.model, self.memo)
        score = _sigmoid(document_parts(logit, lengths) @ self.model.calibration)
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        if spans:
            starts = np.cumsum(lengths) - lengths
            for i in np.unique(np.searchsorted(starts, np.flatnonzero(logit > 0), "right") - 1):
                i = int(i)
                while not lengths[i]:  # empty documents share the next one's start
                    i += 1
                hot = logit[starts[i] : starts[i] + lengths[i]] > 0
                places = _LETTERS.finditer(texts[i])
                found[i] = [(m.start(), m.end()) for m, h in zip(places, hot, strict=True) if h]
        return score, found


def _bounded_rows(rows: DataFrame, limit: int, seed: int = 17) -> DataFrame:
    """Distinct rows of ``rows`` (doc_id, toxic, text; at most ``limit`` doc_ids), about ``limit`` of them at most.

    Where there are more, the doc_ids with most texts keep about the same number each,
    drawn by a hash of the whole row; the others keep all theirs.
    """
    if rows.select("doc_id", "toxic").count() <= limit:
        return rows.distinct()
    rows = rows.distinct()
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("n")).toArrow()
    n = np.sort(sizes["n"].to_numpy())
    if n.sum() <= limit:
        return rows
    # The largest number that all ids together can keep: the smaller ones keep n, the rest share what is left.
    shares = (limit - (np.cumsum(n) - n)) / np.arange(len(n), 0, -1)
    most = float(max(1.0, shares[np.argmax(shares < n)]))
    rates = [(i, most / k) for i, k in zip(sizes["doc_id"].to_pylist(), sizes["n"].to_pylist(), strict=True) if k > most]
    rated = rows.join(rows.sparkSession.createDataFrame(rates, "doc_id long, rate double"), "doc_id", "left")
    grain = 1 << 30
    draw = F.pmod(F.xxhash64("doc_id", "toxic", "text", F.lit(seed)), F.lit(grain))
    return rated.where(F.col("rate").isNull() | (draw < F.col("rate") * grain)).drop("rate")


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 6000) -> Model:
    """Fit on about ``sample_docs`` rows of ``docs`` (doc_id, text) with a label in ``labels`` (doc_id, toxic).

    Where doc_ids repeat, at most about twice as many distinct rows go to the driver.
    """
    marks = bounded_sample(labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null"), sample_docs)
    # Written, at most sample_docs rows: the planner sees that it is small and leaves the texts in place.
    rows = docs.select("doc_id", "text").join(reliable_checkpoint(marks, "marks"), "doc_id")
    rows = rows.select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    found = _bounded_rows(rows, 2 * sample_docs).toArrow().sort_by(
        [("doc_id", "ascending"), ("toxic", "ascending"), ("text", "ascending")]
    )
    return fit([words_of(t) for t in found.column("text").to_pylist()], found.column("toxic").to_pylist())


def score(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """(doc_id, text) -> doc_id, score, predicted, spans (start, end code points of toxic tokens).

    Every row and the whole text; NULL and wordless texts get the score of a text in
    which nothing is toxic.  Repeated rows are scored each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fields(model))  # 2^18 weights

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*sent.value))
        for b in slices(batches):
            p, found = scorer.score(b.column(1).to_pylist(), spans)
            listed = pa.array([[{"start": s, "end": e} for s, e in f] for f in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), listed],
                ["doc_id", "score", "predicted", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        of, "doc_id long, score double, predicted int, spans array<struct<start: int, end: int>>"
    )


def detect(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, **training) -> DataFrame:
    """Learn labels of the folds other than ``held_out``, score all rows: doc_id, held_out, score, predicted, spans."""
    model = train(docs, labels.where(fold("doc_id", folds) != held_out), **training)
    return score(docs, model).select(
        "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", "predicted", "spans"
    )
