"""Held-out accuracy, the ordinal fit itself, and rows without text or label."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunmeter.llm import toxicity
from sunmeter.llm.common import table

BAD = ["vilewort", "nastyish", "grimbold"]


def corpus(seed, n):
    rnd = random.Random(seed)
    plain = [f"{a}{b}" for a in ("sun", "rain", "wind", "lake", "hill") for b in ("ny", "side", "top")]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(20, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rnd.randint(1, 8)):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD) + rnd.choice(["", "s", "er", "!"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = corpus(1, 600)
    docs += [(7, None), (1, "another text of a labelled id")]
    labels += [(None, 1), (9, None), (99999, 1)]
    return toxicity.fit(
        spark.createDataFrame(docs, "doc_id long, text string").withColumn("toxic", F.lit(0)),
        spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_documents_not_seen_are_told_apart(spark, model):
    docs, labels = corpus(2, 400)
    toxic = dict(labels)
    got = toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()
    wrong = [r["doc_id"] for r in got if r["rejected"] != bool(toxic[r["doc_id"]])]
    assert len(wrong) <= 4 and not any(r["rejected"] for r in got if not toxic[r["doc_id"]])


def test_severity_grows_with_what_is_said(model):
    found = [model.severity("sunny hilltop " + "vilewort nastyish " * n)[0] for n in range(8)]
    assert found == sorted(found) and found[0] < 0.5 < 1.5 < found[-1] <= 3
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3


def test_the_fit_finds_known_weights():
    rng = np.random.default_rng(3)
    n = 6000
    x = rng.normal(size=(n, 2))
    latent = x @ np.array([1.5, -0.7]) + rng.logistic(size=n)
    grades = (latent > -0.5).astype(int) + (latent > 1.0) + (latent > 2.0)
    rows, columns = np.indices(x.shape)
    weights, thresholds = toxicity.fit_ordinal(
        rows.ravel(), columns.ravel(), x.ravel(), grades, 2)
    assert np.allclose(weights, [1.5, -0.7], atol=0.15)
    assert np.allclose(thresholds, [-0.5, 1.0, 2.0], atol=0.15)


def test_expected_severity_is_the_sum_of_chances():
    model = toxicity.Model({"=x": 2.0}, (1.0, 2.0))
    above = [1 / (1 + math.exp(t - 2 * math.log1p(3))) for t in (1.0, 2.0)]
    severity, chance, grade = model.severity("x X y x")
    assert severity == pytest.approx(sum(above)) and chance == pytest.approx(above[0]) and grade == 2


def test_clean_keeps_rows_and_columns(spark, model):
    rows = [(1, "sunny"), (2, "vilewort grimbold nastyish"), (3, None), (3, None), (4, ""), (None, "x"),
            (5, "lake " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "1 as severity", "array(1) as rejected")
    got = toxicity.clean(docs, model)
    assert got.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "3", "3", "4", "5", "None"]
    assert toxicity.score(docs, model).count() == len(rows)
    assert toxicity.clean(docs.limit(0), model).count() == 0


def test_without_labels_of_both_kinds_nothing_is_rejected(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    for rows in ([], [(1, 1)], [(1, 0), (2, 0)], [(1, 1), (2, 0)]):
        model = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert toxicity.clean(docs, model).count() == 2


def test_held_out_labels_are_met_in_every_language(spark):
    """Marks that clean documents have now and then are weighed too, not only near-exclusive ones."""
    docs, labels = (table(spark, "/root/testdata/sf0.1", name) for name in ("documents", "labels"))
    model = toxicity.fit(docs, labels.filter("doc_id % 2 = 0"))
    held_out = labels.filter("doc_id % 2 = 1 and toxic is not null").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    marked = docs.select("doc_id", "text", "lang").join(held_out, "doc_id")
    rows = toxicity.score(marked, model).join(marked.select("doc_id", "lang", "toxic"), "doc_id")
    seen = {(r["lang"], r["toxic"] > 0): (r["rejected"], r["n"]) for r in rows.groupBy(
        "lang", "toxic").agg(F.sum(F.col("rejected").cast("int")).alias("rejected"),
                             F.count("*").alias("n")).collect()}
    for (lang, toxic), (rejected, n) in seen.items():
        assert rejected >= 0.85 * n if toxic else rejected <= 0.02 * n, (lang, toxic, rejected, n)
    assert len(seen) == 8
