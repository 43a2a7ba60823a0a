"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades are ordered: P(grade >= k) = logistic(w . x - threshold k) with one
weight vector for all thresholds. x holds the presence of words and of word
beginnings that labelled toxic texts use far more often than clean ones. The
output is the expected severity, the sum of P(grade >= k) over k.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .learning import held_out, training_labels

#: Labelled texts to learn from: toxic ones, and clean ones.
TRAIN_TOXIC, TRAIN_CLEAN = 2000, 4000
#: Features kept, and how many times likelier than in clean texts they must be in toxic ones.
FEATURES, LIFT = 1024, 8.0
#: Chosen features that a toxic training text should hold before it asks for no more.
COVER = 8
#: Severity grades above 0 when labels only tell toxic from clean: parts of the toxic texts by strength of signs.
GRADES = 3
CACHE_WORDS = 200_000
_LETTERS = re.compile(r"[^\W\d_]+")
_BEGINNINGS = (4, 5, 6, 7)


def words_of(text: str) -> set[str]:
    return set(_LETTERS.findall(text.lower()))


def word_features(word: str) -> list[int]:
    """Hashes of the word and of its beginnings."""
    return [zlib.crc32(f"={word}".encode()), *(zlib.crc32(f"<{word[:n]}".encode()) for n in _BEGINNINGS if len(word) >= n)]


@dataclass
class Model:
    weights: dict[int, float]
    thresholds: np.ndarray

    def severity(self, features: set[int]) -> tuple[float, float, int]:
        """Expected severity, P(grade >= 1) and the likeliest grade."""
        score = sum(self.weights[f] for f in features)
        above = 1 / (1 + np.exp(-np.clip(score - self.thresholds, -50, 50)))
        each = np.append(1.0, above) - np.append(above, 0.0)
        return float(above.sum()), float(above[0]), int(each.argmax())


def select(texts: list[np.ndarray], toxic: np.ndarray, features: int = FEATURES, lift: float = LIFT) -> list[int]:
    """Features with the lift that cover the toxic texts: each adds to texts that hold fewer than COVER of those chosen before.

    A word that only comes along with others, say from a passage that toxic texts
    share, has nothing left to cover and stays out.
    """
    clean: Counter = Counter()
    where: dict[int, list[int]] = {}
    n0, n1 = max(1, int((~toxic).sum())), max(1, int(toxic.sum()))
    for i, (ids, t) in enumerate(zip(texts, toxic)):
        if t:
            for f in ids.tolist():
                where.setdefault(f, []).append(i)
        else:
            clean.update(ids.tolist())
    least = max(3, n1 / 250)
    usable = {f: np.array(rows) for f, rows in where.items() if len(rows) >= least and len(rows) / n1 >= lift * (clean.get(f, 0) + 0.5) / n0}
    worth = {f: np.log((len(rows) / n1) / ((clean.get(f, 0) + 0.5) / n0)) for f, rows in usable.items()}
    covered, chosen = np.zeros(len(texts), int), []
    queue = [(-len(rows) * worth[f], f) for f, rows in usable.items()]
    heapq.heapify(queue)
    while queue and len(chosen) < features:
        _, f = heapq.heappop(queue)
        gain = int((covered[usable[f]] < COVER).sum())
        if gain < least:
            continue
        score = -gain * worth[f]
        if queue and score > queue[0][0]:
            heapq.heappush(queue, (score, f))
            continue
        chosen.append(f)
        covered[usable[f]] += 1
    return chosen


def grades_of(x: np.ndarray, toxic: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """0 for clean texts; toxic ones fall into equal parts by the score of a fit that only tells toxic from clean."""
    out = toxic.astype(int)
    weights, _ = fit(x, out)
    score = (x @ weights)[toxic]
    if len(score):
        out[toxic] = 1 + np.searchsorted(np.unique(np.quantile(score, np.arange(1, grades) / grades)), score, side="right")
    return out


def fit(x: np.ndarray, grade: np.ndarray, rounds: int = 500, rate: float = 0.1, penalty: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the cumulative-link model by Adam; weights stay at 0 or above, as every feature is a sign of severity."""
    top = int(grade.max())
    weight = np.where(grade > 0, 0.5 / max(1, (grade > 0).sum()), 0.5 / max(1, (grade == 0).sum()))
    w, gaps = np.full(x.shape[1], 0.1), np.append(3.0, np.zeros(top - 1))  # first threshold, logs of the gaps
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in (w, gaps)]
    logistic = lambda v: 1 / (1 + np.exp(-np.clip(v, -50, 50)))
    rows = np.arange(len(grade))
    for step in range(1, rounds + 1):
        limits = gaps[0] + np.append(0.0, np.cumsum(np.exp(gaps[1:])))
        above = logistic((x @ w)[:, None] - limits[None, :])
        padded = np.hstack([np.ones((len(x), 1)), above, np.zeros((len(x), 1))])
        chance = np.maximum(1e-12, padded[rows, grade] - padded[rows, grade + 1])
        slope = padded * (1 - padded)
        low, high = slope[rows, grade] / chance, slope[rows, grade + 1] / chance
        g_w = x.T @ (weight * (low - high)) - penalty * w
        g_limits = np.zeros(top)
        for k in range(1, top + 1):
            g_limits[k - 1] = (weight * np.where(grade == k, -low, 0)).sum() + (weight * np.where(grade + 1 == k, high, 0)).sum()
        g_gaps = np.append(g_limits.sum(), [g_limits[k:].sum() * np.exp(gaps[k]) for k in range(1, top)])
        for value, gradient, (m, v) in zip((w, gaps), (g_w, g_gaps), state):
            m += 0.1 * (gradient - m)
            v += 0.001 * (gradient**2 - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        np.maximum(w, 0, out=w)
    return w, gaps[0] + np.append(0.0, np.cumsum(np.exp(gaps[1:])))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(np.array([f for w in words_of(t) for f in word_features(w)], np.uint32)).tobytes() for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], names=["x", "grade"])


def trained(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_toxic: int = TRAIN_TOXIC, train_clean: int = TRAIN_CLEAN) -> Model:
    """Fit on bounded samples of labelled texts outside the held-out fold.

    Labels of more than one grade above 0 are used as they are; 0 and 1 alone are
    refined into GRADES by strength. Without toxic or clean texts to learn from,
    the model finds nothing.
    """
    parts = [training_labels(labels.where(condition), id_col, [label_col], most) for condition, most in ((F.col(label_col) > 0, train_toxic), (F.col(label_col) == 0, train_clean))]
    chosen = parts[0].union(parts[1]).select(F.col(id_col).alias("_chosen"), F.col(label_col).cast("int").alias("_grade"))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(F.col(f"`{text_col}`")).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_chosen")).select("_text", "_grade")
    # Only repeated ids make more rows than labels; then those with the smallest features stay, whatever the rows' order.
    sample = rows.mapInArrow(_features, "x binary, grade int").orderBy("x", "grade").limit(2 * (train_toxic + train_clean))
    found = sorted((r["grade"], bytes(r["x"])) for r in sample.collect())
    grade = np.array([g for g, _ in found], int)
    texts = [np.frombuffer(x, np.uint32) for _, x in found]
    chosen_features = select(texts, grade > 0) if len(grade) else []
    if not chosen_features or grade.min() > 0:
        return Model({}, np.full(GRADES, 20.0))
    place = {f: i for i, f in enumerate(chosen_features)}
    x = np.zeros((len(texts), len(place)))
    for i, ids in enumerate(texts):
        x[i, [place[f] for f in ids.tolist() if f in place]] = 1
    if grade.max() == 1:
        grade = grades_of(x, grade > 0)
    w, thresholds = fit(x, grade)
    return Model({f: float(v) for f, v in zip(chosen_features, w) if v > 1e-6}, thresholds)


def _score(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        weights = model.weights

        def signs(word: str) -> tuple[int, ...]:
            if len(known) >= CACHE_WORDS:
                known.clear()
            known[word] = found = tuple(f for f in word_features(word) if f in weights)
            return found

        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                rows = []
                for text in part.column("_text").to_pylist():
                    hits: set[int] = set()
                    for w in words_of(text):
                        own = known.get(w)
                        if own is None:
                            own = signs(w)
                        if own:
                            hits.update(own)
                    rows.append(model.severity(hits))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.float64(), pa.float64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.drop_columns(["_text"]).columns, *columns], names=["_id", "_held", "severity", "p_toxic", "grade"])

    return run


def severity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, held_out, severity (expected grade), p_toxic, grade and toxic.

    Defined cases: a null or empty text shows no sign and gets the model's lowest
    severity; null ids are kept; repeated rows are scored once each; an empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), held_out(F.col(f"`{id_col}`")).alias("_held"), text_of(F.col(f"`{text_col}`")).alias("_text"))
    out = rows.mapInArrow(_score(model), f"_id {dict(rows.dtypes)['_id']}, _held boolean, severity double, p_toxic double, grade int")
    return out.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "severity", "p_toxic", "grade", (F.col("p_toxic") >= 0.5).alias("toxic"))
