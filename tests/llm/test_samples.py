"""What the bounded samples of the classifiers must not lose."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from modlens.llm import language


def test_rare_language_is_learned_beside_a_large_one(spark):
    rng = random.Random(5)
    say = lambda words: " ".join(rng.choice(words) for _ in range(30))
    large, rare = ["the", "and", "house", "walking", "through", "there"], ["och", "från", "också", "går", "hälsa", "själv"]
    rows = [(i, say(large), "en") for i in range(4000)] + [(10_000 + i, say(rare), "sv") for i in range(8)] + [(20_000 + i, None, "xx") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language.fit_languages(docs, F.lit(True), 40, 1 << 24)
    assert sorted(models) == ["en", "sv"]
    asked = spark.createDataFrame([(1, say(rare)), (2, say(large))], "doc_id long, text string")
    assert [r["lang_pred"] for r in language.identify(asked, models).orderBy("doc_id").collect()] == ["sv", "en"]
    # each tree is of about 40 documents, or of all 8: a byte of each order-0 context was counted
    size = {k: m.orders[0].counts.sum() for k, m in models.items()}
    assert size["sv"] == sum(len(t.encode()) for _, t, k in rows if k == "sv")
    assert 20 < size["en"] * 4000 / sum(len(t) for _, t, k in rows if k == "en") < 70
