"""Toxicity by a classifier chain of logistic regressions on hashed words.

Each category's model is linear in the words, in the log ratios of the text's most telling words, and in the probabilities of the
categories before it. While a chain is trained, those come from models fitted on other folds, so a later model learns from
probabilities as good as it will get in use. Models are fitted in tasks, one fold each, on a bounded sample of labelled documents;
scoring is one pass over all texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import store

BUCKETS = 1 << 18
SAMPLE = 8000
"""Labelled rows that the models are fitted on, at most about this many, chosen by a hash of the id."""
FOLDS = 4
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def word_buckets(text: bytes) -> np.ndarray:
    """Sorted distinct hash buckets of the words of a text, letters only."""
    words = set(text.translate(_LETTERS).split())
    return np.unique(np.fromiter((zlib.crc32(w) % BUCKETS for w in words), dtype=np.int32, count=len(words)))


def _log_ratio(positive: np.ndarray, negative: np.ndarray, positives: float, negatives: float) -> np.ndarray:
    """How much likelier a word is in positive texts than in negative ones, as a logarithm, smoothed by half a text or so."""
    share = positives / max(positives + negatives, 1.0)
    return np.log((positive + share + 1e-9) / (positives + 1)) - np.log((negative + 1 - share + 1e-9) / (negatives + 1))


def _strongest(ratios: np.ndarray) -> tuple[float, float]:
    """The largest ratio of a text's words and the sum of its three largest: one telling word counts, however long the text."""
    if not len(ratios):
        return 0.0, 0.0
    top = np.partition(ratios, len(ratios) - min(3, len(ratios)))[-3:]
    return float(top.max()), float(top.sum())


def _flat(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*words, np.empty(0, dtype=np.int32)]).astype(np.int64), np.array([len(w) for w in words], dtype=np.int64)


def _margin(flat: np.ndarray, lengths: np.ndarray, extra: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``weights``: buckets, then one for each column of ``extra``, then the intercept."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    words = np.bincount(row, weights=weights[flat], minlength=len(lengths)) if len(flat) else np.zeros(len(lengths))
    return words + extra @ weights[BUCKETS:-1] + weights[-1]


def predict(words: list[np.ndarray], earlier: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Probability of a category. ``earlier`` has a column for each category before; a model is its words' ratios, then its weights."""
    ratios, weights = model[:BUCKETS], model[BUCKETS:].astype(np.float64)
    telling = np.array([_strongest(ratios[w]) for w in words]).reshape(-1, 2)
    return _sigmoid(_margin(*_flat(words), np.column_stack([telling, earlier]), weights))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(words: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.05, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression by full-batch steps of adaptive size: L2-regularised word weights, and free ones for the words' ratios
    and the categories before. A row's own label is taken out of the counts behind its ratios."""
    flat, lengths = _flat(words)
    row = np.repeat(np.arange(len(words)), lengths)
    weights = np.zeros(BUCKETS + 2 + earlier.shape[1] + 1)
    if not len(y) or y.min() == y.max():         # one class only: its rate, smoothed
        share = (y.sum() + 1.0) / (len(y) + 2.0)
        weights[-1] = np.log(share / (1 - share))
        return np.concatenate([np.zeros(BUCKETS), weights])
    positive, negative = (np.bincount(flat, weights=v[row], minlength=BUCKETS) for v in (y, 1 - y))
    positives, negatives = float(y.sum()), float((1 - y).sum())
    telling = [_strongest(_log_ratio(positive[w] - k, negative[w] - (1 - k), positives - k, negatives - (1 - k))) for w, k in zip(words, y)]
    extra = np.column_stack([np.array(telling), earlier])
    weights[-1] = np.log(y.mean() / (1 - y.mean()))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        error = (_sigmoid(_margin(flat, lengths, extra, weights)) - y) / len(y)
        gradient = np.zeros_like(weights)
        gradient[:BUCKETS] = penalty * weights[:BUCKETS] / len(y) ** 0.5 + np.bincount(flat, weights=error[row], minlength=BUCKETS)
        gradient[BUCKETS:-1] = extra.T @ error
        gradient[-1] = error.sum()
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient ** 2
        weights -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-4)
    return np.concatenate([_log_ratio(positive, negative, positives, negatives), weights])


def _features(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``words`` (distinct buckets) in place of ``text``, the other ``columns`` kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([word_buckets(t.as_py()) for t in batch.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([words, *[batch.column(c) for c in columns]], ["words", *columns])

    kinds = dict(docs.dtypes)
    return docs.select("text", *columns).mapInArrow(run, ", ".join(["words array<int>", *[f"`{c}` {kinds[c]}" for c in columns]]))


def train_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], id_column: str = "doc_id", text: str = "text",
                sample: int = SAMPLE, folds: int = FOLDS) -> list[np.ndarray]:
    """Weights of each category in order. ``labels`` has the id and a 0/1 column per category; rows with a null are left out."""
    known = labels.select(F.col(id_column).alias("id"), *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(categories)]).dropna()
    known = known.groupBy("id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
    share = min(1.0, sample / max(known.count(), 1))
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000)
    chosen = store(known.where(draw), "toxicity-labels")
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    ys = [f"y{i}" for i in range(len(categories))]
    fold = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(folds)).cast("int")
    one = rows.join(chosen, "id").groupBy("id", *ys).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))   # a row per id
    table = store(_features(one.select("id", "t.text", *ys).withColumn("fold", fold), ["fold", *ys]), "toxicity-sample")
    spread = table.withColumn("left_out", F.explode(F.sequence(F.lit(0), F.lit(folds)))).where("left_out <> fold")  # `folds`: the model of all

    models: list[list[np.ndarray]] = []          # per category: one per fold left out, then the one of all
    for at in range(len(categories)):
        found = spread.groupBy("left_out").applyInPandas(_fold_fit(f"y{at}", list(models)), "left_out int, weights binary")
        fitted = {r["left_out"]: np.frombuffer(r["weights"], dtype=np.float32) for r in found.collect()}   # two megabytes per fold
        own = [fitted.get(k, np.zeros(2 * BUCKETS + 2 + at + 1, dtype=np.float32)) for k in range(folds + 1)]
        models.append(own)
    return [m[folds] for m in models]


def _fold_fit(label: str, models: list[list[np.ndarray]]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Fits the model of one category on the rows of all folds but one."""
    def one(part: pd.DataFrame) -> pd.DataFrame:
        words = [np.asarray(w) for w in part["words"]]
        weights = fit(words, _earlier(words, part["fold"].to_numpy(), models), part[label].to_numpy())
        return pd.DataFrame({"left_out": [part["left_out"].iloc[0]], "weights": [weights.astype(np.float32).tobytes()]})

    return one


def _earlier(words: list[np.ndarray], fold: np.ndarray, models: list[list[np.ndarray]]) -> np.ndarray:
    """Logits of the categories before, each row's from the models that were fitted without its fold."""
    extra = np.zeros((len(words), 0))
    for own in models:
        logits = np.zeros(len(words))
        for k in np.unique(fold):
            at = np.flatnonzero(fold == k)
            logits[at] = _logit(predict([words[i] for i in at], extra[at], own[k]))
        extra = np.column_stack([extra, logits])
    return extra


def classify(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], id_column: str = "doc_id", text: str = "text",
             threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: ``id``, ``p_<category>`` of each category in chain order, and the last category as a boolean.

    A null or empty text has no words and gets about the base rate. Long texts are read whole; one telling word counts in them as in
    short ones. Without labels every probability is one half and nothing is flagged. Repeated rows are scored each on its own, and so
    are rows with a null id, which have no label. Extra columns aren't looked at.
    """
    models = train_chain(docs, labels, categories, id_column, text, sample)
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_buckets(t.as_py()) for t in batch.column("text")]
            extra, found = np.zeros((len(words), 0)), []
            for model in models:
                found.append(predict(words, extra, model))
                extra = np.column_stack([extra, _logit(found[-1])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *map(pa.array, found), pa.array(found[-1] > threshold)], ["id", *[f"p_{c}" for c in categories], categories[-1]])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"p_{c} double" for c in categories) + f", {categories[-1]} boolean")
