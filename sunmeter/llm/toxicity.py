"""Toxicity: ordinal regression on sparse text features, giving an expected severity."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmeter.llm.common import drawn, flat_map_rows, map_rows, settled, small_batches

PER_CLASS = 4_000  # labelled documents of each kind the model is fitted on, at most
MAX_FEATURES = 20_000
PREFIXES = (3, 4, 5)
LEAST_Z = 5.0  # how far above chance a feature's share of toxic documents is, in standard errors
GRADE_WORDS = (1, 3, 6)  # telling words from which toxic documents get grade 1, 2, 3
REJECT = 0.5
SEED = 2
STEPS, RATE, DECAY = 600, 0.05, 1e-3

_WORDS = re.compile(r"[^\W\d_]+").findall


@dataclass(frozen=True)
class Model:
    """P(grade >= k) = sigmoid(weights . features - thresholds[k - 1]).

    The weights are shared by all thresholds, which ascend.
    """

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    @cached_property
    def starts(self) -> frozenset[str]:
        """How the words of all features begin."""
        return frozenset(name[1:1 + PREFIXES[0]] for name in self.weights)

    def severity(self, text: str | None) -> tuple[float, float, int]:
        """Expected grade, probability of grade 1 or more, and the likeliest grade."""
        starts, size = self.starts, PREFIXES[0]
        words = [word for word in words_of(text) if word[:size] in starts]
        score = sum(self.weights[name] * math.log1p(n)
                    for name, n in features(words).items() if name in self.weights)
        above = [1 / (1 + math.exp(min(700.0, t - score))) for t in self.thresholds]
        each = [a - b for a, b in zip([1.0, *above], [*above, 0.0])]
        return sum(above), above[0], max(range(len(each)), key=each.__getitem__)


def words_of(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def features(words: Iterable[str]) -> Counter[str]:
    """How often each word (after "=") and each word's first letters (after "^") stand there."""
    counts: Counter[str] = Counter()
    for word, n in Counter(words).items():
        counts["=" + word] += n
        for size in PREFIXES:
            if len(word) >= size:
                counts["^" + word[:size]] += n
    return counts


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """id, toxic and text of at most ``per_class`` labelled documents of each kind.

    They are drawn by a seeded hash of the id.  A document with several labels is
    toxic if one says so; of several texts of one id the least counts.
    """
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        "doc_id").agg(F.max("toxic").alias("toxic"))
    toxic, other = (drawn(marked.filter(kind), "doc_id", per_class, SEED)
                    for kind in (F.col("toxic") > 0, F.col("toxic") <= 0))
    chosen = toxic.union(other)  # no more than 2 * per_class rows
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy(
        "doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model fitted on a bounded sample of the labelled documents.

    Labels only say toxic or not, so severity is graded first: features are telling
    that stand more often in toxic documents than chance allows, however many other
    documents have them too (the regression weighs them), and a toxic
    document has the grade that its number of telling words reaches in
    ``GRADE_WORDS``; one without any has grade 1, other documents 0.  The driver
    gets the telling features of the sample, which its bounds limit.  Without
    toxic or without other documents, or without telling features, the model
    rejects nothing.
    """
    rows = settled(flat_map_rows(
        sample(docs, labels, per_class).select("doc_id", "toxic", "text"), lambda: _counted,
        "doc_id long, toxic boolean, feature string, n long"), "toxic-features")
    sizes = {row["toxic"]: row["count"]
             for row in rows.filter("feature = ''").groupBy("toxic").count().collect()}
    toxic, other = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not other:
        return Model({}, (math.inf,))
    found = rows.filter("feature <> ''").groupBy("feature").agg(
        F.count(F.when(F.col("toxic"), 1)).alias("a"),
        F.count(F.when(~F.col("toxic"), 1)).alias("b"))
    share = (F.col("a") + F.col("b")) / (toxic + other)
    z = (F.col("a") / toxic - F.col("b") / other) / F.sqrt(
        share * (1 - share) * (1 / toxic + 1 / other) + 1e-12)
    telling = settled(
        found.filter(z >= LEAST_Z)
        .orderBy(z.desc(), "feature").limit(MAX_FEATURES).select("feature"), "telling")
    kept = rows.join(F.broadcast(telling), "feature").select(
        "doc_id", "toxic", "feature", "n").collect()
    return fit_counts([(r["doc_id"], r["toxic"], r["feature"], r["n"]) for r in kept], toxic, other)


def _counted(key, toxic, text) -> list[tuple]:
    toxic, counts = toxic > 0, features(words_of(text))
    return [(key, toxic, "", 0), *[(key, toxic, name, n) for name, n in counts.items()]]


def fit_counts(
    counts: Iterable[tuple[int, bool, str, int]], toxic: int, other: int,
) -> Model:
    """The model from counts of telling features by document, and the numbers of documents."""
    counts = sorted(counts)
    names = sorted({name for _, _, name, _ in counts})
    if not names:
        return Model({}, (math.inf,))
    documents = sorted({(key, flag) for key, flag, _, _ in counts})
    row_of = {key: row for row, (key, _) in enumerate(documents)}
    column_of = {name: column for column, name in enumerate(names)}
    telling: Counter[tuple[int, int]] = Counter()
    for key, _, name, n in counts:
        telling[key, len(name) if name[0] == "^" else 0] += n  # words, by size of beginning
    sizes = (0, *(1 + size for size in PREFIXES))
    grades = [sum(max(telling[key, size] for size in sizes) >= least for least in GRADE_WORDS)
              if flag else 0 for key, flag in documents]
    # Documents without any telling feature are rows of zeros.
    grades += [1] * (toxic - sum(flag for _, flag in documents))
    grades += [0] * (other - sum(not flag for _, flag in documents))
    at = np.array([(row_of[key], column_of[name]) for key, _, name, _ in counts])
    values = np.log1p(np.array([n for *_, n in counts], float))
    weights, thresholds = fit_ordinal(
        at[:, 0], at[:, 1], values, np.array(grades), len(names))
    return Model(dict(zip(names, weights.tolist())), tuple(thresholds.tolist()))


def fit_ordinal(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the cumulative-link model with the logistic link.

    The matrix is given by its entries.  Thresholds are the first one and the
    logs of the steps to the next, so they ascend; weights are held back by
    ``DECAY``.  Gradient steps are adapted to each parameter; all is deterministic.
    """
    k = int(max(1, grades.max()))
    parameters = np.concatenate([np.zeros(n_features), [0.5], np.zeros(k - 1)])
    first = np.zeros_like(parameters)
    second = np.zeros_like(parameters)
    n = len(grades)
    for step in range(1, STEPS + 1):
        weights = parameters[:n_features]
        jumps = np.exp(parameters[n_features + 1:])
        thresholds = parameters[n_features] + np.concatenate([[0.0], np.cumsum(jumps)])
        score = np.bincount(rows, values * weights[columns], n)
        edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
        low, high = _sigmoid(edges[grades] - score), _sigmoid(edges[grades + 1] - score)
        chance = np.maximum(high - low, 1e-9)
        slope_low, slope_high = low * (1 - low) / chance, high * (1 - high) / chance
        by_score = slope_low - slope_high
        gradient = np.zeros_like(parameters)
        gradient[:n_features] = (
            np.bincount(columns, values * by_score[rows], n_features) / n - DECAY * weights)
        by_threshold = np.array([
            (slope_high[grades == j].sum() - slope_low[grades == j + 1].sum()) / n
            for j in range(k)])
        gradient[n_features] = by_threshold.sum()
        gradient[n_features + 1:] = jumps * np.cumsum(by_threshold[::-1])[::-1][1:]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient ** 2
        parameters = parameters + RATE * (first / (1 - 0.9 ** step)) / (
            np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    jumps = np.exp(parameters[n_features + 1:])
    return (parameters[:n_features],
            parameters[n_features] + np.concatenate([[0.0], np.cumsum(jumps)]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def score(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: ``severity``, ``p_toxic``, ``grade`` and ``rejected``.

    Severity is the expected grade; a document is rejected where grade 1 or more
    is likelier than not.  Null and empty texts have no features; repeated rows
    give repeated rows; other columns are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_FEATURES

    def per_task():
        severity = shared.value.severity

        def of(key, value):
            expected, chance, grade = severity(value)
            return key, expected, chance, grade, chance >= REJECT

        return of

    return map_rows(
        docs.select(id_column, text), per_task,
        f"`{id_column}` {kind}, severity double, p_toxic double, grade int, rejected boolean")


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs``, with all columns, without the rows that the model rejects; nothing is shuffled."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        severity = shared.value.severity
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(text)).to_pylist()
            kept = [severity(value)[1] < REJECT for value in values]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
