"""Operators that learn: held-out accuracy, and brute force for the exact parts."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import boosting, ppm, quality, weak_labels
from folioscope.llm.arrays import flat
from folioscope.llm.queries import language_query, quality_query, toxicity_query
from tests.llm.odd import frame, rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def rate(df, condition):
    row = df.agg(F.avg(F.expr(condition).cast("double")), F.count("*")).first()
    assert row[1] > 20
    return row[0]


def test_quality_on_held_out_rows(spark, labels):
    found = quality_query(spark, SF).join(labels.filter("quality is not null"), "doc_id").filter("held_out").cache()
    assert rate(found, "predicted = quality") > 0.95


def test_toxicity_on_held_out_rows(spark, labels):
    found = toxicity_query(spark, SF).join(labels.filter("toxic is not null"), "doc_id").filter("held_out").cache()
    assert rate(found, "predicted = toxic") > 0.9
    assert found.filter("toxic = 0 and predicted = 1").count() <= 1


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    assert rate(language_query(spark, SF).join(docs, "doc_id").filter("held_out"), "lang = lang_pred") > 0.98


def test_forest_equals_its_trees():
    rng = np.random.default_rng(1)
    values = rng.normal(size=(600, 5))
    label = (values[:, 0] * values[:, 1] > 0).astype(int)
    forest = boosting.fit(values, label, trees=30, depth=3)
    total = np.full(600, forest.base)
    for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
        for row in range(600):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(values[row, f[node]] > t[node])
            total[row] += leaf[node - len(f)]
    assert np.allclose(forest.score(values), 1 / (1 + np.exp(-total)))
    assert ((forest.score(values) > 0.5) == label).mean() > 0.9
    assert boosting.fit(values[:0], label[:0]).score(values[:2]).tolist() == [0.5, 0.5]
    assert 0.9 < boosting.fit(values[:50], np.ones(50)).score(values[:1])[0] < 1


def ppm_brute(counts, text):
    body, total = text.lower().encode() if text.isascii() else text.encode(), 0.0
    padded = b" " * ppm.ORDER + body
    for k in range(ppm.ORDER, len(padded)):
        for depth in range(ppm.ORDER, -1, -1):
            context = padded[k - depth : k]
            seen = counts.get(context)
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if seen[padded[k]]:
                total -= math.log2(seen[padded[k]] / whole)
                break
            total -= math.log2(len(seen) / whole)
        else:
            total += 8
    return total


def test_code_lengths():
    learned, asked = ["the cat sat on the mat", "that hat"], ["the hat", "zzz", "", "a mat that sat"]
    counts: dict = {}
    for text in learned:
        padded = b" " * ppm.ORDER + text.encode()
        for k in range(ppm.ORDER, len(padded)):
            for depth in range(ppm.ORDER + 1):
                counts.setdefault(padded[k - depth : k], Counter())[padded[k]] += 1
    gram, n = np.unique(ppm.grams(*flat(pa.array(learned))), return_counts=True)
    tree = ppm.ContextTree(gram.astype(np.uint64), n.astype(float))
    for text in asked:
        assert math.isclose(tree.bits(ppm.grams(*flat(pa.array([text]))).astype(np.uint64)).sum(), ppm_brute(counts, text), abs_tol=1e-9)


def test_language_of_odd_rows(spark):
    found = ppm.identify(frame(spark), ppm.train(frame(spark)), carry=["doc_id", "text", "row"]).collect()
    assert len(found) == len(rows())
    for r in found:
        text = r["row"]["text"]
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "de") and 0 <= r["score"] <= 1
    nothing = ppm.train(frame(spark, []))
    assert {(r["lang_pred"], r["score"]) for r in ppm.identify(frame(spark), nothing).collect()} == {("und", 0.0)}
    assert ppm.identify(frame(spark, []), nothing).count() == 0


@pytest.mark.parametrize("module", [quality, weak_labels])
def test_scores_of_odd_rows(spark, module):
    column = "quality" if module is quality else "toxic"
    marked = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)] + [(None, 1, 1), (3, None, None), (4, 1, 1), (4, 0, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    model = module.train(frame(spark), marked, column)
    found = module.score(frame(spark), model, carry=["doc_id", "batch", "label"]).collect()
    assert len(found) == len(rows()) and all(0 <= r["score"] <= 1 for r in found)
    bare = module.train(frame(spark), marked.limit(0), column)
    assert all(0 <= r["score"] <= 1 for r in module.score(frame(spark), bare).collect())
    assert module.score(frame(spark, []), model).count() == 0


def test_label_model_finds_rates_and_repeats():
    rng = np.random.default_rng(2)
    toxic = rng.random(6000) < 0.15
    rates = [(0.6, 0.01), (0.5, 0.02), (0.4, 0.005), (0.7, 0.02)]
    votes = np.stack([np.where(toxic, rng.random(6000) < hit, rng.random(6000) < miss) for hit, miss in rates], axis=1).astype(float)
    votes = np.concatenate([votes, votes[:, :1]], axis=1)
    model = weak_labels.fit_label_model(votes, 0.15)
    assert model.weight[0] < 0.8 and model.weight[4] < 0.8 and model.weight[1] > 0.8
    assert abs(model.rates[1][3] - 0.7) < 0.1 and model.rates[0][3] < 0.05
    assert ((model.posterior(votes) > 0.5) == toxic).mean() > 0.95
