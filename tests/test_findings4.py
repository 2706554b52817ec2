"""Findings of round 4: the ledger's operators."""

import random

from pyspark.sql import functions as F

from tokenledger import staging
from tokenledger.operators import duplicates


def test_sets_that_merely_share_words_are_no_pairs(spark, monkeypatch):
    """A word that many sets begin with (one that the ranking doesn't know yet): pairs are shuffled and compared only where they may be similar."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(600)]
    sets = [["again", *rng.sample(words, rng.randrange(6, 40))] for _ in range(120)]
    sets += [["again", *s[1:-1], "other"] for s in sets[:30]]
    compared = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def similarity(x, y):
        compared.add(1)
        return len(set(x) & set(y)) / len(set(x) | set(y))

    monkeypatch.setattr(duplicates, "jaccard", similarity.asNondeterministic())
    df = staging.save(spark.createDataFrame(list(enumerate(sets)), "id long, words array<string>"), "t")
    got = {(r["a"], r["b"]) for r in duplicates.similar_sets(df, [], 0.7).collect()}
    near = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.7
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and near(a, b)}
    assert got == want and len(want) >= 60
    assert len(want) / 2 <= compared.value <= 2 * len(want)  # without the filter: thousands
    new, old = df.where("id >= 100"), df.where("id < 100")
    assert {(r["a"], r["b"]) for r in duplicates.similar_sets(new, [], 0.7, old).collect()} == {(i, j) for i, j in want if i >= 100}
