"""The sample of the language fit: rare languages, and any order of the rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from nightgrid.llm import languages


def test_rare_languages_are_learned_whatever_the_order(spark):
    # One row in 5,000 is of the third language, two thirds are of the first; ids repeat.
    lang = F.when(F.col("id") % 5000 == 7, "rare").when(F.col("id") % 3 == 0, "b").otherwise("a")
    word = F.when(lang == "rare", "zyx wvu qpo ").when(lang == "b", "lorem ipsum ").otherwise("the quick fox ")
    docs = spark.range(20_000).select((F.col("id") % 900).alias("doc_id"), F.concat(word, F.col("id").cast("string")).alias("text"), lang.alias("lang"),
                                      F.lit(1).alias("_rows"), F.lit("x").alias("rank"))
    model = languages.learn(docs, rows=300)
    assert model.langs == ["a", "b", "rare"]
    again = languages.learn(docs.orderBy(F.desc("text")).repartition(5), rows=300)
    assert np.array_equal(model.table, again.table) and model.threshold == again.threshold
    assert model.predict("zyx wvu")[0] == "rare" and model.predict("ipsum lorem")[0] == "b"
