"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from a logistic score over its words
and the words' letter groups and beginnings, and the bag's probability is their noisy-or: 1 - prod(1 - p). Labels exist
for documents only; the gradient of the bag's likelihood reaches every sentence, so that the trained
scores also tell which sentences offend.

The model is fitted on a bounded sample of labelled rows (``MAX_LABELLED``, the ids of smallest hash). The
executors count in how many toxic and clean documents of the sample each feature occurs; every feature
that is far more frequent in toxic ones is taken, and the ridge holds the weights. The sample's sentences
come to the one fitting task as sets of these features with the number of their sentences, so that long
documents don't weigh on it. The model is then applied to every whole text without a shuffle. Labels,
language, source and id are never inputs of a score.

A null or empty text has no sentences and the bag's lowest score. Rows without doc_id are scored; labels
of unknown documents are ignored, rows that repeat a doc_id count once in fitting (the least text) and are
scored each on its own, an empty table of labels
gives every document score 0, an empty table of documents an empty result. Texts are scored whole,
however long. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.memory import tidy
from textloom.session import materialize

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_sentences long, offending string"
#: Documents the model is fitted on at most.
MAX_LABELLED = 5_000
MIN_POSITIVE = 3
GRAM = 4
BEGINNINGS = (6, 7, 8, 9)
CACHE_WORDS = 200_000
FOLDS = 5

SENTENCES = re.compile(r"[^.!?\n]+")
WORDS = re.compile(r"[^\W\d_]+").findall


def features(word: str) -> list[str]:
    """The word itself, its groups of GRAM letters, and its beginnings, the start and the end marked."""
    shown = f"^{word}$"
    groups = {shown[i : i + GRAM] for i in range(len(shown) - GRAM + 1)}
    return [shown, *groups.union(shown[:k] for k in BEGINNINGS if k < len(shown))]


class Model:
    def __init__(self, bias: float, weights: dict[str, float]) -> None:
        self.bias, self.weights, self.words = bias, weights, {}

    def to_json(self) -> str:
        return json.dumps({"bias": self.bias, "weights": self.weights})

    @classmethod
    def of_json(cls, text: str) -> Model:
        return cls(**json.loads(text))

    def word(self, word: str) -> float:
        found = self.words.get(word)
        if found is None:
            found = sum(self.weights.get(f, 0.0) for f in features(word))
            if len(self.words) < CACHE_WORDS:
                self.words[word] = found
        return found

    def score(self, text: str) -> tuple[float, int, list[int]]:
        """The bag's probability, the number of sentences, and the places of those that offend."""
        known, word_of, log_clean, n, found = self.words, self.word, 0.0, 0, []
        for n, sentence in enumerate(SENTENCES.findall(text.lower()), 1):
            z = self.bias
            for w in set(WORDS(sentence)):
                x = known.get(w)
                z += word_of(w) if x is None else x
            log_clean -= math.log1p(math.exp(z)) if z < 30 else z
            if z >= 0:
                found.append(n - 1)
        return max(0.0, -math.expm1(log_clean)), n, found


def is_telling(with_it: float, without: float, n1: float, n0: float) -> bool:
    """Whether a feature occurs in far more toxic than clean documents than chance would have it."""
    p, q = with_it / n1, without / n0
    z = (p - q) / math.sqrt((p * (1 - p) + 1 / n1) / n1 + (q * (1 - q) + 1 / n0) / n0)
    return with_it >= MIN_POSITIVE and z >= 3 and p >= 4 * q


Bag = list[tuple[tuple[int, ...], int]]


def bag_of(text: str | None, chosen: dict[str, int], words: dict[str, tuple[int, ...]]) -> Bag:
    """The sentences of a text as sets of chosen features, each with the number of such sentences."""
    found = Counter()
    for sentence in SENTENCES.findall((text or "").lower()):
        own: list[int] = []
        for w in set(WORDS(sentence)):
            mine = words.get(w)
            if mine is None:
                mine = words[w] = tuple(chosen[f] for f in features(w) if f in chosen)
            own += mine
        found[tuple(sorted(own))] += 1
    return sorted(found.items())


def fit(bags: list[Bag], labels: list[int], names: list[str], steps: int = 500, rate: float = 0.1, ridge: float = 1e-3) -> Model:
    """Minimises the bags' negative log likelihood plus a ridge by Adam."""
    toxic = np.array(labels, bool)
    if not toxic.any():
        return Model(-40.0, {})
    rows, columns, owner, times = [], [], [], []
    for k, bag in enumerate(bags):
        for own, n in bag:
            rows += [len(owner)] * len(own)
            columns += own
            owner.append(k)
            times.append(n)
    rows, columns, owner = (np.array(x, np.int64) for x in (rows, columns, owner))
    times = np.array(times, float)
    n, m, bags_n = len(owner), len(names), len(bags)
    theta = np.zeros(m + 1)
    theta[m] = math.log(max(1e-6, toxic.mean()) / max(1, times.sum() / max(1, bags_n)))
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    for step in range(1, steps + 1):
        z = theta[m] + np.bincount(rows, theta[columns], n)
        total = np.bincount(owner, times * np.logaddexp(0, z), bags_n)
        slope = np.where(toxic, -1 / np.expm1(np.maximum(total, 1e-9)), 1.0)  # of the loss by each bag's sum
        pull = times * slope[owner] / (1 + np.exp(-z))
        grad = np.append(np.bincount(columns, pull[rows], m)[:m], pull.sum()) / bags_n
        grad[:m] += ridge * theta[:m] / max(1.0, bags_n / 1000)
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(float(theta[m]), {f: round(float(theta[i]), 6) for i, f in enumerate(names)})


def remainder(doc_id: str, mod: int):  # noqa: ANN201
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fits on at most ``max_labelled`` labelled documents whose crc32(doc_id) mod 5 is not 0."""
    picked = (
        labels.select("doc_id", "toxic")
        .where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .where(remainder("doc_id", FOLDS) != 0)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # max_labelled ids at most
    sample = materialize(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for batch in batches:
            counts = Counter()
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = set(WORDS((text.as_py() or "").lower()))
                for w in words - known.keys():
                    known[w] = features(w)
                counts.update((f, toxic > 0) for f in {f for w in words for f in known[w]})
            if counts:
                keys, n = zip(*counts.items(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in keys]), pa.array([t for _, t in keys]), pa.array(n, pa.int64())], ["feature", "toxic", "n"])

    sizes = sample.agg(F.count_if(F.col("toxic") > 0).alias("n1"), F.count_if(F.col("toxic") <= 0).alias("n0")).first()
    if not sizes.n1:
        return Model(-40.0, {})
    counted = sample.select("toxic", "text").mapInArrow(tidy(count), "feature string, toxic boolean, n long").groupBy("feature")
    counted = counted.agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("b"))
    # features of three documents or more of the bounded sample
    names = sorted(r.feature for r in counted.where(F.col("a") >= MIN_POSITIVE).collect() if is_telling(r.a, r.b, sizes.n1, max(1, sizes.n0)))
    told = docs.sparkSession.sparkContext.broadcast(names)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, words = {f: i for i, f in enumerate(told.value)}, {}
        for batch in batches:
            bags = [json.dumps(bag_of(t.as_py(), chosen, words)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.string())], ["doc_id", "toxic", "bag"])

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        return pd.DataFrame({"model": [fit([json.loads(b) for b in rows.bag], rows.toxic.tolist(), names).to_json()]})

    bags = sample.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(tidy(cells), "doc_id long, toxic int, bag string")
    return Model.of_json(bags.groupBy(F.lit(0).alias("all")).applyInPandas(fitted, "model string").first().model)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Every document with its score and the places of its offending sentences, in one pass."""
    told = docs.sparkSession.sparkContext.broadcast(model.to_json())  # weights of the bounded sample's features

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of_json(told.value)
        for batch in batches:
            rows = [model.score(t.as_py() or "") for t in batch.column(2)]
            scores = [round(s, 9) for s, _, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    pa.array([n for _, n, _ in rows], pa.int64()),
                    pa.array([",".join(map(str, x)) for _, _, x in rows], pa.string()),
                ],
                ["doc_id", "held_out", "score", "predicted", "n_sentences", "offending"],
            )

    held = F.coalesce(remainder("doc_id", FOLDS) == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(tidy(work), SCHEMA)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, with all their columns, that the model does not find toxic; one pass, no shuffle."""
    told, place = docs.sparkSession.sparkContext.broadcast(model.to_json()), docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of_json(told.value)
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py() or "")[0] < 0.5 for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(tidy(work), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    return score_documents(docs, train(docs, labels, max_labelled))
