"""Many patterns in texts, against looking for each."""

import random

import pytest

from weftline.operators.patterns import matches


@pytest.mark.parametrize("at_once", [100_000, 40])
def test_matches(spark, at_once):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcé/") for _ in range(rng.randrange(n)))
    texts = [(k, word(60)) for k in range(150)] + [(None, "abc"), (7, None), (3, "abc"), (3, "abc")]
    patterns = [word(6) for _ in range(150)] + [None, "abc", "abc", "bc", "c"]
    df = spark.createDataFrame(texts, "k int, text string").selectExpr("*", "1 AS pattern", "2 AS `a.b`")
    got = matches(df, spark.createDataFrame([(p,) for p in patterns], "pattern string"), "k", at_once=at_once)
    want = [(k, p) for k, t in texts if t is not None for p in {*patterns} - {None} if p in t]
    assert got.columns == ["k", "pattern"] and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_nothing(spark):
    texts, patterns = spark.createDataFrame([(1, "a")], "k int, text string"), spark.createDataFrame([("a",)], "pattern string")
    assert matches(texts, patterns.limit(0), "k").count() == 0 and matches(texts.limit(0), patterns, "k").count() == 0


def test_ten_thousand_patterns(spark):
    texts = spark.range(2_000).selectExpr("id AS k", "concat('https://e.example/', id * 5, '/x') AS text")
    patterns = spark.range(10_000).selectExpr("concat('/', id, '/') AS pattern")
    got = matches(texts, patterns, "k")
    assert sorted((r.k, r.pattern) for r in got.collect()) == [(k, f"/{5 * k}/") for k in range(2_000)]
