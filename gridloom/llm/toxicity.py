"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary texts, give a text's likelihood word by word. A word is spelled by its nested
beginnings (``LEVELS`` characters, then the whole): at each level an absolutely discounted class-conditional estimate backs off
to counts that both classes share, where a beginning counts once for each distinct continuation it has. So a rare word, seen in
neither class, is judged by the longest beginning that was seen, and where the classes only have the shared counts they
agree and the word says nothing. A word counts once for each text that has it, and equal texts count once.

A toxic text is mostly ordinary words, so its model is a mixture: each word is ordinary, or with probability ``RATE`` drawn
from the toxic model. The log-likelihood ratio of a common word is then about nothing, instead of noise that adds up. The
score compares the length-normalised log-likelihoods through a logistic curve.

Labels are learned only from labelled rows outside fold 0. The models are fitted on a bounded sample of them:
``most_rows`` of each class, those of smallest hash; a fourth of these only serves to fit the logistic curve, since
a model flatters the texts it was made of. Whole texts count. Scoring needs no exchange: the model, bounded by the
sample, is broadcast.

Nulls: a null text is empty; an empty text gets the score of zero evidence. Null ids or labels are never learned from.
Several labels for one id count as their maximum. Without any labelled rows of both classes every score is 0. Repeated rows
get equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import chunks, fold_of, small_batches, strings

LEVELS = (3, 4, 5, 6)
DISCOUNT = 0.75
RATE = 0.01
EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_"


def spelled(word: str) -> list[str]:
    """The nested beginnings of a word, from the empty one to the whole, which ends in a line break as its mark."""
    return ["", *(word[:k] for k in LEVELS if k < len(word)), word + "\n"]


@dataclass
class Model:
    """evidence: log-likelihood ratio (toxic to ordinary) of a beginning with all shorter ones; unseen: what is added where its continuation was never seen."""

    evidence: dict[str, float]
    unseen: dict[str, float]
    slope: float = 1.0
    offset: float = 0.0

    def word(self, word: str) -> float:
        """Log-likelihood ratio of a word between toxic texts, as mixtures, and ordinary ones."""
        return math.log1p(RATE * math.expm1(self.ratio(word)))

    def ratio(self, word: str) -> float:
        total, last = 0.0, ""
        for part in spelled(word.strip(EDGES))[1:]:
            if part not in self.evidence:
                return total + self.unseen.get(last, 0.0)
            total, last = self.evidence[part], part
        return total

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * evidence + self.offset))))


class Words(dict):
    """Evidence of words as they stand in texts, kept for at most ``most_kept`` of them."""

    def __init__(self, model: Model, most_kept: int = 100_000):
        self.model, self.most_kept = model, most_kept

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most_kept:
            self.clear()
        self[word] = out = self.model.word(word)
        return out

    def text(self, text: str) -> tuple[float, int]:
        """Length-normalised evidence, and the number of words."""
        words = text.lower().split()
        return (sum(map(self.__getitem__, words)) / len(words) if words else 0.0), len(words)


def fitted(counts: dict[str, list[int]]) -> Model:
    """A model from each word's counts in ordinary and toxic texts."""
    children: dict[str, dict[str, list[float]]] = defaultdict(dict)
    for word, pair in counts.items():
        parts = spelled(word)
        for parent, child in zip(parts, parts[1:]):  # noqa: B905
            c = children[parent].setdefault(child, [0.0, 0.0])
            c[0] += pair[0]
            c[1] += pair[1]
    evidence, unseen = {"": 0.0}, {}
    for parent in sorted(children, key=len):  # a beginning's own evidence is known before its continuations'
        inside = children[parent]
        distinct = {child: len(children.get(child, ())) or 1 for child in inside}  # continuation counts, shared by the classes
        whole = sum(distinct.values())
        totals = [sum(c[k] for c in inside.values()) for k in (0, 1)]
        left = [DISCOUNT * sum(c[k] > 0 for c in inside.values()) / totals[k] if totals[k] else 1.0 for k in (0, 1)]
        above = evidence[parent]
        unseen[parent] = math.log(left[1] / left[0])
        for child, c in inside.items():
            shared = (distinct[child] + 0.5) / (whole + 1)
            p = [max(c[k] - DISCOUNT, 0) / totals[k] + left[k] * shared if totals[k] else shared for k in (0, 1)]
            evidence[child] = above + math.log(p[1] / p[0])
    return Model(evidence, unseen)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic regression with a small ridge, by Newton steps."""
    scale = float(np.abs(x).mean()) or 1.0
    design, b = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + 1e-2 * b
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        b -= step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return float(b[0] / scale), float(b[1])


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 3000) -> Model | None:
    """The model of a bounded sample of labelled rows outside fold 0; None without rows of both classes."""
    spark = docs.sparkSession
    told = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold_of() != 0)
    rows, n = [], {}
    for kind in (0, 1):
        own = told.where(F.col("toxic") == kind)
        n[kind] = own.count()
        rows += [(r[0], kind, i % 4 == 3) for i, r in enumerate(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).collect())]
    if not n[0] or not n[1]:
        return None
    sample = spark.createDataFrame(rows, "doc_id bigint, toxic int, judge boolean")
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most 2 * most_rows rows
    picked = picked.groupBy("text", "toxic").agg(F.min("judge").alias("judge"), F.min("doc_id").alias("doc_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 8 << 20):
            seen = (Counter(), Counter())
            for text, toxic, judge in zip(strings(batch.column("text")), batch.column("toxic").to_pylist(), batch.column("judge").to_pylist(), strict=True):
                if not judge:
                    seen[toxic].update({w.strip(EDGES) for w in text.lower().split()})
            words = list({**seen[0], **seen[1]})
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([s[w] for w in words], pa.int64()) for s in seen)], names=["word", "plain", "toxic"])

    partial = picked.mapInArrow(count, "word string, plain bigint, toxic bigint")
    model = fitted({w: [a, b] for w, a, b in partial.groupBy("word").agg(F.sum("plain"), F.sum("toxic")).collect()})
    judged = evidence(picked.where("judge"), spark.sparkContext.broadcast(model), ["toxic"]).select("toxic", "evidence").collect()
    if len({t for t, _ in judged}) == 2:
        y = np.array([t for t, _ in judged], float)
        share = n[1] / (n[0] + n[1])
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        model.slope, model.offset = logistic(np.array([e for _, e in judged]), y, weight)
    return model


def evidence(docs: DataFrame, model, more: list[str]) -> DataFrame:
    """(doc_id, evidence, n_words and the columns ``more``) of every row."""
    kept = docs.select("doc_id", "text", *more)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model.value)
        for batch in chunks(batches, "text", 8 << 20):
            got = [words.text(t) for t in strings(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([e for e, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int64()), *(batch.column(c) for c in more)], names=["doc_id", "evidence", "n_words", *more])

    schema = ", ".join(["doc_id bigint, evidence double, n_words bigint", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in more)])
    return kept.mapInArrow(task, schema)


def scores(docs: DataFrame, labels: DataFrame, most_rows: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence, n_words of every row of ``docs``."""
    model = learn(docs, labels, most_rows) or Model({"": 0.0}, {}, 0.0, -30.0)
    found = evidence(docs, docs.sparkSession.sparkContext.broadcast(model), [])
    score = 1 / (1 + F.exp(-(F.col("evidence") * model.slope + model.offset)))
    return found.select("doc_id", (fold_of() == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "evidence", "n_words")


def without_toxic(docs: DataFrame, labels: DataFrame, most_rows: int = 3000, texts: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, unchanged: the judgement is made on each row's own text, without a join.

    The model is learned from the labelled rows of ``texts``, which are ``docs`` unless given.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = learn(texts if texts is not None else docs, labels, most_rows) or Model({"": 0.0}, {}, 0.0, -30.0)
    shared = spark.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value)
        for batch in chunks(batches, "text", 1 << 20):
            yield batch.filter(pa.array([shared.value.score(words.text(t)[0]) < 0.5 for t in strings(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
