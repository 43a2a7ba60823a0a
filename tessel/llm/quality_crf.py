"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its score comes from its own features and those of
the lines before and after; transitions favour runs of one label. The marginals
of forward-backward, weighted by line length, give the document's quality.
Lines take their document's label in training, on all lines of a bounded sample
of documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .learning import held_out, training_labels

#: Labelled documents to learn from; the fit looks at all their lines.
TRAIN_DOCS = 6000
#: Lines, padding included, that the fit handles at once (or one document).
CHUNK_LINES = 1 << 18
ACCEPT = 0.3

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&<>~^=_@{}[]\\/+"
_ENDS = (b".", b"!", b"?", b'"', b":")
N_OWN = 12


def lines_of(text: bytes) -> list[bytes]:
    """The lines that have a word, or one empty line."""
    return [x for x in text.split(b"\n") if x.split()] or [b""]


def features(lines: list[bytes]) -> np.ndarray:
    """[lines, N_OWN]: counts in proportion to words or bytes, shape of the line, repetition."""
    out, seen = [], set()
    for line in lines:
        words = line.split()
        n, size = max(1, len(words)), max(1, len(line))
        gone = lambda chars: (len(line) - len(line.translate(None, chars)))
        out.append((
            math.log1p(len(words)),
            1 - len(set(words)) / n,
            min(4.0, line.count(b"|") / n),
            min(4.0, gone(_SYMBOLS) / n),
            min(4.0, line.count(b"!") / n),
            gone(_UPPER) / size,
            gone(_DIGITS) / size,
            min(20.0, size / n),
            float(line.rstrip().endswith(_ENDS)),
            min(2.0, line.count(b",") / n),
            float(line in seen),
            float(len(words) < 4),
        ))
        seen.add(line)
    return np.array(out, np.float64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after (0 at the ends), and 1."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    return np.hstack([own, before, after, np.ones((len(own), 1))])


@dataclass
class Crf:
    """emit: weight of each feature for good against bad; move[i, j]: score of label j after label i."""

    mean: np.ndarray
    scale: np.ndarray
    emit: np.ndarray
    move: np.ndarray

    def scores(self, own: np.ndarray) -> np.ndarray:
        return with_neighbours((own - self.mean) / self.scale) @ self.emit


def marginals(emissions: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded chains.

    emissions: [chains, lines] score of good against bad. Returns P(good) per
    line, expected transitions [chains, 2, 2] and log Z per chain.
    """
    chains, steps = emissions.shape
    local = np.stack([np.zeros_like(emissions), emissions], axis=2)
    peak = local.max(axis=2, keepdims=True)
    local = np.exp(local - peak)
    table = np.exp(move)
    inside = np.arange(steps)[None, :] < lengths[:, None]
    forward, norm = np.empty((chains, steps, 2)), np.ones((chains, steps))
    for t in range(steps):
        now = local[:, t] if t == 0 else (forward[:, t - 1] @ table) * local[:, t]
        norm[:, t] = now.sum(axis=1)
        forward[:, t] = now / norm[:, t, None]
    backward = np.ones((chains, steps, 2))
    pairs = np.zeros((chains, 2, 2))
    for t in range(steps - 2, -1, -1):
        ahead = local[:, t + 1] * backward[:, t + 1] / norm[:, t + 1, None]
        go = inside[:, t + 1]
        backward[:, t] = np.where(go[:, None], ahead @ table.T, 1.0)
        pairs += np.where(go[:, None, None], forward[:, t, :, None] * table * ahead[:, None, :], 0.0)
    both = forward * backward
    logz = ((np.log(norm) + peak[:, :, 0]) * inside).sum(axis=1)
    return both[:, :, 1] / both.sum(axis=2), pairs, logz


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), lengths.max(), *rows[0].shape[1:]))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, lengths


def fit(documents: list[np.ndarray], good: np.ndarray, rounds: int = 120, rate: float = 0.15, penalty: float = 1e-3) -> Crf:
    """Maximum conditional likelihood by Adam over whole passes; all lines carry their document's label.

    Both labels weigh the same in total. Deterministic.
    """
    every = np.vstack(documents)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    order = np.argsort([len(d) for d in documents], kind="stable")
    chunks, at = [], 0
    while at < len(order):
        shortest, end = len(documents[order[at]]), at + 1
        while end < len(order) and end - at < 512 and (n := len(documents[order[end]])) <= 1.3 * shortest + 64 and n * (end - at + 1) <= CHUNK_LINES:
            end += 1
        part = order[at:end]
        x, lengths = padded([(documents[i] - mean) / scale for i in part])
        chunks.append((x, lengths, good[part].astype(float)))
        at = end
    share = max(1e-6, min(1 - 1e-6, float(good.mean())))
    emit, move = np.zeros(3 * N_OWN + 1), np.zeros((2, 2))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (emit, move)]
    for step in range(1, rounds + 1):
        g_emit, g_move, lines = -penalty * emit, -penalty * move, 0
        for x, lengths, label in chunks:
            weight = np.where(label > 0, 0.5 / share, 0.5 / (1 - share)) / np.sqrt(lengths)
            # Neighbours are read from the lines themselves, which lie in memory once.
            own, before, after = (x @ emit[k * N_OWN : (k + 1) * N_OWN] for k in range(3))
            emissions = own + emit[-1]
            emissions[:, 1:] += before[:, :-1]
            emissions[:, :-1] += after[:, 1:]
            p, pairs, _ = marginals(emissions, lengths, move)
            inside = np.arange(x.shape[1])[None, :] < lengths[:, None]
            error = (label[:, None] - p) * inside * weight[:, None]
            parts = [np.tensordot(e, v, 2) for e, v in ((error, x), (error[:, 1:], x[:, :-1]), (error[:, :-1], x[:, 1:]))]
            g_emit = g_emit + np.concatenate([*parts, [error.sum()]]) / len(documents)
            seen = np.zeros((len(label), 2, 2))
            seen[np.arange(len(label)), label.astype(int), label.astype(int)] = lengths - 1
            g_move = g_move + ((seen - pairs) * weight[:, None, None]).sum(axis=0) / len(documents)
            lines += inside.sum()
        for value, gradient, (m, v) in zip((emit, move), (g_emit, g_move), state):
            m += 0.1 * (gradient - m)
            v += 0.001 * (gradient**2 - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(mean, scale, emit, np.clip(move, -3, 3))


def quality(texts: list[bytes], model: Crf) -> np.ndarray:
    """Length-weighted mean of P(good) over each text's lines."""
    split = [lines_of(t) for t in texts]
    out = np.empty(len(texts))
    order = np.argsort([len(x) for x in split], kind="stable")
    at = 0
    while at < len(order):
        longest, end = len(split[order[at]]), at + 1
        while end < len(order) and end - at < 512 and len(split[order[end]]) <= 1.3 * longest + 4:
            end += 1
        part = order[at:end]
        emissions, lengths = padded([model.scores(features(split[i])) for i in part])
        p, _, _ = marginals(emissions, lengths, model.move)
        for row, i in zip(p, part):
            size = np.array([max(1, len(x)) for x in split[i]], float)
            out[i] = float(row[: len(size)] @ size / size.sum())
        at = end
    return np.clip(out, 0.0, 1.0)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [features(lines_of(t)).tobytes() for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), batch.column(1)], names=["x", "good"])


def trained(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS) -> Crf:
    """Fit on at most train_docs labelled documents outside the held-out fold.

    Without a labelled document, or with one class only, the model gives every
    document the probability of the smoothed class share.
    """
    chosen = training_labels(labels, id_col, [label_col], train_docs).select(F.col(id_col).alias("_chosen"), F.col(label_col).cast("int").alias("_good"))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(F.col(f"`{text_col}`")).cast("binary").alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_chosen")).select("_text", "_good")
    # Only repeated ids make more rows than labels; then those with the smallest features stay, whatever the rows' order.
    sample = rows.mapInArrow(_features, "x binary, good int").orderBy("x", "good").limit(2 * train_docs)
    found = sorted((r["good"], bytes(r["x"])) for r in sample.collect())
    good = np.array([g for g, _ in found], float)
    if len(set(good.tolist())) < 2:
        emit = np.zeros(3 * N_OWN + 1)
        emit[-1] = math.log((good.sum() + 1) / (len(good) - good.sum() + 1))
        return Crf(np.zeros(N_OWN), np.ones(N_OWN), emit, np.zeros((2, 2)))
    return fit([np.frombuffer(x).reshape(-1, N_OWN) for _, x in found], good)


def _score(model: Crf) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                scores = quality(part.column("_text").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*part.drop_columns(["_text"]).columns, pa.array(scores)], names=[*(c for c in part.schema.names if c != "_text"), "score"])

    return run


def scored(docs: DataFrame, model: Crf, *, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """One row per document: the id, held_out, score and predicted (1 from accept on).

    Defined cases: a null text counts as the empty text, which is one line
    without words and gets a score like any other; a null id is kept; repeated
    rows are scored once each; an empty table gives an empty result; other
    columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), held_out(F.col(f"`{id_col}`")).alias("_held"), text_of(F.col(f"`{text_col}`")).cast("binary").alias("_text"))
    out = rows.mapInArrow(_score(model), f"_id {dict(rows.dtypes)['_id']}, _held boolean, score double")
    return out.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Crf, *, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The rows of docs with a score from accept on, with all their columns; the score is taken in one pass."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(quality([t or b"" for t in texts], model))

    return docs.where(score(text_of(F.col(f"`{text_col}`")).cast("binary")) >= accept)
