"""The fit of toxicity scores: damped steps, a binding sample bound, repeated rows, short texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexgiving.llm import toxicity
from hexgiving.llm.common import fold

SF = "/root/testdata/sf0.01"


def test_calibration_of_separable_and_wild_measures_is_finite():
    rng = np.random.default_rng(1)
    for scale in (1.0, 30.0, 1e3):
        y = (np.arange(2000) % 10 == 0).astype(float)
        x = np.column_stack([y * 8 * scale, y * 5 * scale + rng.random(2000) * 1e-3, np.repeat(0.0, 2000), np.ones(2000)])
        beta = toxicity._calibrate(x, y)
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -700, 700)))
        assert np.isfinite(beta).all() and p[y == 1].min() > 0.3 > p[y == 0].max()


def test_calibration_that_is_not_finite_is_an_error():
    with pytest.raises(ValueError):
        toxicity._calibrate(np.array([[np.inf, 1.0], [1.0, 1.0]]), np.array([0.0, 1.0]))
    model = toxicity.Model(np.zeros((toxicity.SIZE,) * 3), {}, np.array([np.nan] * 4))
    with pytest.raises(ValueError):
        model.score("text")


def test_binding_sample_flags_about_the_labelled_share(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = docs.select("doc_id").join(labels, "doc_id")
    share = known.agg(F.avg("toxic")).first()[0]
    for rows in (150, 250):
        model = toxicity.learn(docs, labels, train=toxicity.training_rows(), sample_rows=rows)
        assert np.isfinite(model.calibration).all()
        scored = toxicity.with_scores(docs.select("doc_id", "text"), model, out="score").join(labels, "doc_id")
        flagged, caught = scored.agg(F.avg((F.col("score") >= 0.3).cast("int")),
                                     F.avg(F.when(F.col("toxic") == 1, (F.col("score") >= 0.3).cast("int")))).first()
        assert 0.4 * share < flagged < 1.8 * share and caught > 0.4
    assert model.score("a quiet morning") < 0.3


def test_a_row_repeated_any_number_of_times_is_one_sample_row(spark):
    docs = spark.createDataFrame([(1, "one clean text of words")] * 3000 + [(i, f"clean words {i}") for i in range(2, 60)]
                                 + [(i, f"vile slur {i}") for i in range(60, 90)], "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(1, 90)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, sample_rows=10_000)
    assert model.score("vile slur") > 0.3 > model.score("one clean text of words")
    assert model.weights and np.isfinite(model.calibration).all()
    held = toxicity.with_scores(docs, model).where(fold("doc_id", 4) == 2)
    assert held.count() == held.where("toxicity BETWEEN 0 AND 1").count() > 0
