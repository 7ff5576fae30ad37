"""The toxicity model's decision doesn't depend on whether the labels were thinned."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import toxicity


@pytest.mark.parametrize("per_class", [4000, 100])
def test_odds(spark, per_class):
    """Texts that say nothing about their labels, one in ten of which is toxic: thinned or not, none is likely to be."""
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice("red green blue black white grey".split()) for _ in range(40)), int(i % 10 == 0)) for i in range(1500)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), per_class=per_class))
    mean, rejected = scored.agg(F.avg("score"), F.avg("predicted")).first()
    assert 0.03 < mean < 0.3 and rejected < 0.1
