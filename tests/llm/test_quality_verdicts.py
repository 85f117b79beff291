"""Verdicts joined for undecided rows only equal those joined for all rows."""

import random

from piisift.llm import quality


def test_verdicts_equal_judge(spark):
    rnd = random.Random(3)
    good = lambda: " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rnd.randrange(999)) for _ in range(60))
    bad = lambda: "# $ % & spam " * 30
    rows = [(i, rnd.choice([bad, bad, bad, good])() if i % 3 == 0 else good(), "bad" if i % 3 == 0 else rnd.choice(["a", "b", None])) for i in range(300)]
    rows += [(i, "### ### a b c d e f g h i j k l m n o p q r s t u v w x y z", "bad") for i in range(300, 330)] + [(400, None, "bad"), (401, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    measured = quality.written(quality.measure_documents(docs), "t")
    cols = ["doc_id", "base_failed", "strict_failed", "kept"]
    one, two = (sorted(map(tuple, f(measured).select(*cols).collect())) for f in (quality.judge, quality.verdicts))
    assert one == two and len(one) == len(rows)
    assert any(not kept and not base for _d, base, _s, kept in one) and any(kept for *_, kept in one)
    assert sorted(r["doc_id"] for r in quality.keep_documents(docs).collect()) == [d for d, _b, _s, kept in one if kept]
