"""Language identification in two steps: the family, then one-versus-one linear SVMs inside it.

Features are hashed character n-grams and whole words, counted per word, so
every linear score of a text is a mean over its words and a word's scores can be
remembered. Families are found from the training texts: languages whose mean
features are more alike than languages are on average belong together.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import held_out

DIMENSIONS = 4096
#: Training texts per language aimed at, and in all. Scoring reads every text whole.
PER_LANGUAGE, TRAIN_DOCS = 300, 4000
#: Remembered word scores in a worker: rows, and bytes of all of them.
CACHE_WORDS, CACHE_BYTES = 200_000, 64 << 20
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode's categories L) of the lower-case text."""
    words = _LETTERS.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, words)):
        return words
    # The pattern also lets numbers such as ½ and Ⅷ through.
    return "".join(c if c.isalpha() else " " for c in " ".join(words)).split()


_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of lower-case words' n-grams (1 to 4 characters, with borders) and of the words themselves, and whose each is.

    All words are hashed at once, as rolling hashes over one array of characters.
    """
    code = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    whole = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % DIMENSIONS for w in words], np.int64)
    places, owners = [whole], [np.arange(len(words))]
    h = np.zeros(len(code), np.uint64)
    for k in range(min(4, len(code))):
        n = len(code) - k
        h = (h[:n] + np.uint64(1)) * _FACTOR + code[k:]
        inside = owner[:n] == owner[k:]
        mixed = h[inside]
        mixed = (mixed ^ (mixed >> np.uint64(33))) * _MIX
        places.append(((mixed ^ (mixed >> np.uint64(29))) % np.uint64(DIMENSIONS)).astype(np.int64))
        owners.append(owner[:n][inside])
    return np.concatenate(places), np.concatenate(owners)


def text_features(text: str) -> np.ndarray | None:
    """Mean over the words of their feature counts, or None without letters."""
    words = words_of(text)
    if not words:
        return None
    out = np.zeros(DIMENSIONS)
    for at in range(0, len(words), 20_000):
        out += np.bincount(features_of(words[at : at + 20_000])[0], minlength=DIMENSIONS)
    return (out / len(words)).astype(np.float32)


@dataclass
class Model:
    """weights [features, outputs] and bias: first one output per family, then one per language pair of a family."""

    families: list[list[str]]
    pairs: list[tuple[int, str, str]]
    weights: np.ndarray
    bias: np.ndarray


def svm(x: np.ndarray, sign: np.ndarray, rounds: int = 150, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by accelerated gradient steps; both sides weigh the same."""
    weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    data = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    weight, sign = weight.astype(np.float32), sign.astype(np.float32)
    step = 1.0 / (2 * float((weight * (data**2).sum(axis=1)).sum()) + penalty)
    w = np.zeros(data.shape[1], np.float32)
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        slack = np.maximum(0.0, 1 - sign * (data @ ahead))
        new = ahead - np.float32(step) * (np.float32(penalty) * ahead - 2 * ((weight * slack * sign) @ data))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + np.float32((t - 1) / after) * (new - w), new, after
    return w[:-1], float(w[-1])


def families_of(names: list[str], centres: np.ndarray) -> list[list[str]]:
    """Average-linkage groups of languages that are more alike than the mean of all pairs."""
    centred = centres - centres.mean(axis=0)
    unit = centred / (np.linalg.norm(centred, axis=1, keepdims=True) + 1e-12)
    like = unit @ unit.T
    groups = [[i] for i in range(len(names))]
    level = like[np.triu_indices(len(names), 1)].mean() if len(names) > 2 else 2.0
    while len(groups) > 2:
        score, a, b = max((float(like[np.ix_(g, h)].mean()), -i, -j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        if score <= level:
            break
        groups[-a] += groups.pop(-b)
    return [sorted(names[i] for i in g) for g in groups]


def fit(x: np.ndarray, lang: np.ndarray) -> Model:
    names = sorted(set(lang.tolist()))
    scale = x.std(axis=0) + 1e-3
    z = (x / scale).astype(np.float32)
    centres = np.stack([z[lang == n].mean(axis=0) for n in names])
    families = families_of(names, centres)
    of = {n: i for i, g in enumerate(families) for n in g}
    family = np.array([of[n] for n in lang.tolist()])
    outputs, pairs = [], []
    for i in range(len(families)):
        outputs.append(svm(z, np.where(family == i, 1.0, -1.0)) if len(families) > 1 else (np.zeros(x.shape[1]), 1.0))
    for i, group in enumerate(families):
        for k, a in enumerate(group):
            for b in group[k + 1 :]:
                rows = (lang == a) | (lang == b)
                outputs.append(svm(z[rows], np.where(lang[rows] == a, 1.0, -1.0)))
                pairs.append((i, a, b))
    return Model(families, pairs, np.stack([w for w, _ in outputs], axis=1) / scale[:, None], np.array([b for _, b in outputs]))


class Scorer:
    """Scores of texts, with the scores of words remembered up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}
        self.weights = np.ascontiguousarray(model.weights)
        # Many languages have many outputs a word; the bound on bytes then holds fewer words.
        outputs = model.weights.shape[1]
        self.rows = max(1024, min(CACHE_WORDS, CACHE_BYTES // (8 * outputs)))
        self.at_once = max(64, 2_000_000 // (32 * outputs))
        self.table = np.zeros((self.rows, outputs))

    def _learn(self, words: list[str]) -> None:
        """Put the scores of new words into the table."""
        for at in range(0, len(words), self.at_once):
            part = words[at : at + self.at_once]
            places, owners = features_of(part)
            order = np.argsort(owners, kind="stable")
            first = np.searchsorted(owners[order], np.arange(len(part)))
            base = len(self.known)
            self.table[base : base + len(part)] = np.add.reduceat(self.weights[places[order]], first, axis=0)
            self.known.update(zip(part, range(base, base + len(part))))

    def outputs(self, words: list[str]) -> np.ndarray:
        total = np.zeros(self.table.shape[1])
        step = min(50_000, self.rows)
        for at in range(0, len(words), step):
            part = words[at : at + step]
            new = list(dict.fromkeys(w for w in part if w not in self.known))
            if len(self.known) + len(new) > self.rows:
                self.known.clear()
                new = list(dict.fromkeys(part))
            if new:
                self._learn(new)
            rows = np.fromiter(map(self.known.__getitem__, part), np.int64, len(part))
            total += self.table[rows].sum(axis=0)
        return total / len(words) + self.model.bias

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words:
            return UNDETERMINED, 0.0
        model, out = self.model, self.outputs(words)
        n = len(model.families)
        ranked = np.argsort(-out[:n], kind="stable")
        best = int(ranked[0])
        sure = _sigmoid(out[best] - out[ranked[1]]) if n > 1 else 1.0
        group = model.families[best]
        votes = {name: [0, 0.0] for name in group}
        for (i, a, b), margin in zip(model.pairs, out[n:]):
            if i == best:
                votes[a if margin >= 0 else b][0] += 1
                votes[a][1] += margin
                votes[b][1] -= margin
        winner = max(group, key=lambda name: (*votes[name], name))
        duels = [_sigmoid(2 * (m if a == winner else -m)) for (i, a, b), m in zip(model.pairs, out[n:]) if i == best and winner in (a, b)]
        return winner, float(sure * min(duels, default=1.0))


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(place, lang, x.tobytes()) for place, lang, text in zip(*(c.to_pylist() for c in batch.columns)) if (x := text_features(text)) is not None]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.binary()))], names=["place", "lang", "x"])


def trained(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, train_docs: int = TRAIN_DOCS) -> Model | None:
    """Fit on a bounded sample of texts with a language, outside the held-out fold; None if there are none.

    Every language gives about per_language texts: a hash of the row decides, at
    a rate that its number of rows sets, so rare languages are there in full. Of
    more languages than train_docs those with most texts are learned. Equal
    tables give equal models, however their rows are dealt.
    """
    key = F.col(f"`{id_col}`")
    rows = docs.where(~held_out(key) & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(key.cast("string").alias("_key"), F.col(f"`{lang_col}`").cast("string").alias("_lang"), F.col(f"`{text_col}`").alias("_text"))
    found = rows.groupBy("_lang").count().orderBy(F.col("count").desc(), "_lang").limit(train_docs).collect()
    if not found:
        return None
    aim = min(per_language, max(2, train_docs // len(found)))
    rates = docs.sparkSession.createDataFrame([(r["_lang"], min(1.0, aim / r["count"])) for r in found], "_lang string, _rate double")
    place = F.pmod(F.xxhash64(F.coalesce("_key", F.lit("")), "_text"), F.lit(1 << 30))
    # The rates are as many as the languages counted, train_docs at most.
    chosen = rows.withColumn("_place", place).join(F.broadcast(rates), "_lang").where(F.col("_place") / float(1 << 30) < F.col("_rate"))
    sample = chosen.select("_place", "_lang", "_text").mapInArrow(_collected, "place bigint, lang string, x binary").orderBy("place", "lang", "x").limit(2 * train_docs)
    taken = sorted((r["lang"], bytes(r["x"])) for r in sample.collect())
    if not taken:
        return None
    return fit(np.stack([np.frombuffer(x, np.float32) for _, x in taken]), np.array([lang for lang, _ in taken], object))


def _predict(model: Model | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model) if model else lambda text: (UNDETERMINED, 0.0)
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                rows = [score(t) for t in part.column("_text").to_pylist()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.drop_columns(["_text"]).columns, *columns], names=["_id", "_held", "lang_pred", "score"])

    return run


def identified(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, held_out, lang_pred and score.

    Defined cases: a null text, or one without a letter, is und with score 0, and
    so is every text if there was nothing to learn from; null ids are kept;
    repeated rows are predicted once each; an empty table gives an empty result;
    other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), held_out(F.col(f"`{id_col}`")).alias("_held"), F.col(f"`{text_col}`").alias("_text"))
    out = rows.mapInArrow(_predict(model), f"_id {dict(rows.dtypes)['_id']}, _held boolean, lang_pred string, score double")
    return out.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "lang_pred", "score")
