import math
import os

import pytest

from sieveline.llm import mixing as p8
from sieveline.llm import tokenize as p7

pytestmark = pytest.mark.skipif(not os.path.exists(f"{p7.TOKENIZERS}/{p7.TOKENIZER}.json"), reason="no tokenizer files")
TARGETS = "source string, target_share double, max_repeats int, tokens int"


def corpus(spark, rows):
    return spark.createDataFrame([(i, s, t, "x") for i, (s, t) in enumerate(rows)], "doc_id bigint, source string, text string, rate string")


def test_shares_and_caps(spark):
    rows = [("big", "word " * (1 + i % 40)) for i in range(600)] + [("small", "word " * (1 + i % 25)) for i in range(60)] + [(None, "x"), ("other", "x"), ("big", None), ("small", "")]
    targets = spark.createDataFrame([("big", 0.5, 1, 0), ("small", 0.4, 3, 0), ("none", 0.1, 2, 0), (None, 0.3, 1, 0)], TARGETS)
    mixed = p8.mix(corpus(spark, rows), targets).cache()
    got = {r.source: r for r in p8.shares(mixed, targets.filter("source is not null")).collect()}
    assert math.isclose(got["big"].actual_share, 5 / 9, rel_tol=0.01) and math.isclose(got["small"].actual_share, 4 / 9, rel_tol=0.01)
    assert got["none"].actual_share == 0 and got["none"].tokens_used == 0
    assert got["small"].most_copies <= 3 and got["big"].most_copies <= 1
    assert mixed.filter("source is null or source = 'other' or tokens = 0").count() == 0
    ids = [r.doc_id for r in mixed.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) == 660


def test_tilt_is_exponential_and_meets_the_goal(spark):
    rows = [("a", "word " * (1 + i % 30)) for i in range(300)] + [("b", "word " * 10)] * 10
    targets = spark.createDataFrame([("a", 0.7, 2, 0), ("b", 0.3, 4, 0)], TARGETS)
    mixed = p8.mix(corpus(spark, rows), targets).filter("source = 'a'").collect()
    logs = sorted({(r.tokens, round(math.log(r.rate) / r.tokens, 9)) for r in mixed if 0 < r.rate < 2})
    assert len({x for _, x in logs}) == 1
    given = sum(r.tokens * r.copies for r in mixed)
    assert abs(given - sum(r.tokens * r.rate for r in mixed)) <= min(r.tokens for r in mixed)


def test_a_total_beyond_reach_gives_all_there_is(spark):
    rows = [("a", "word word")] * 10 + [("b", "word word")] * 10
    targets = spark.createDataFrame([("a", 0.5, 1, 0), ("b", 0.5, None, 0)], TARGETS)
    mixed = p8.mix(corpus(spark, rows), targets, total=1e9).collect()
    assert {r.copies for r in mixed} == {1} and len(mixed) == 20


def test_equal_documents_are_split_exactly(spark):
    """One cell holds everything: its copies are chosen part by part and still add up."""
    rows = [("a", "same text here")] * 997 + [("b", "same text here")] * 100
    targets = spark.createDataFrame([("a", 0.8, 1, 0), ("b", 0.2, 1, 0)], TARGETS)
    mixed = p8.mix(corpus(spark, rows), targets)
    assert {r.source: r.n for r in mixed.groupBy("source").agg(p8.F.sum("copies").alias("n")).collect()} == {"a": 400, "b": 100}


def test_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 1, 0)], TARGETS)
    assert p8.mix(corpus(spark, []), targets).count() == 0
    assert p8.mix(corpus(spark, [("a", "x")]), targets.limit(0)).count() == 0
