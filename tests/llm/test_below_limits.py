import random

import numpy as np

from corpusloom.llm import isolation
from corpusloom.llm.rule_stats import text_stats


def test_texts_of_long_words_can_be_rejected(spark):
    rng, rows = random.Random(4), []
    for i in range(600):
        least, most = (8, rng.randint(14, 30)) if i % 60 == 0 else (2, 8)
        rows.append((i, " ".join("".join(rng.choices("abcdefghij", k=rng.randint(least, most))) for _ in range(80)) + ".", int(i % 60 > 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 120 < 61], "doc_id long, quality int")
    out = isolation.quality_rules(docs, labels).collect()
    assert {r.doc_id for r in out if not r.kept} == {r[0] for r in rows if not r[2]}
    assert isolation.quality_rules(docs, labels.filter("quality = 1")).filter("NOT kept").count() == 0


def test_mean_lengths_do_not_grow_with_texts():
    one = "some words here\nand more words\n"
    a, b = isolation.shares(text_stats([one, one * 500]))
    assert np.allclose(a[-2:], b[-2:])
