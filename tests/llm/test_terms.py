import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sieveline.llm import terms as p5


@pytest.mark.parametrize("n", [0, 1, 100, 4095, 4096, 5000, 65536])
def test_containers(n):
    low = np.sort(np.random.default_rng(n).choice(65536, n, replace=False)).astype("<u2")
    c = p5.pack(low)
    assert p5.cardinality(c) == n
    assert (p5.unpack(c) == low).all()


def test_union():
    a, b = np.arange(0, 5000, dtype="<u2"), np.arange(4000, 9000, dtype="<u2")
    assert p5.cardinality(p5.union([p5.pack(a), p5.pack(b), p5.pack(np.array([7], "<u2"))])) == 9000


def test_against_counting(spark):
    rows = [(i, f"hot.rule-{i % 7} Hot", None if i % 5 else "CWE-79: X", "") for i in range(300)] + [(70_000 + i, "Einzel.größe", "cwe_79", "a") for i in range(2)] + [(0, "hot again", None, None), (None, "lost", None, "a"), (1 << 40, "x" * 50_000, None, None)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "finding_id bigint, rule_id string, cwe_id string, category string, term string, block int").repartition(5)
    times, records = Counter(), defaultdict(set)
    for k, (i, *values) in enumerate(rows):
        for field, value in zip(("rule_id", "cwe_id", "category"), values, strict=True):
            for t in re.findall(r"[^\W_]+", (value or "").lower()):
                times[field, t] += 1
                records[field, t].add(("null", k) if i is None else i)
    total = len({("null", k) if r[0] is None else r[0] for k, r in enumerate(rows)})
    want = {(f, t): (n, len(records[f, t]), total) for (f, t), n in times.items()}
    got = {(r.field_name, r.term): (r.occurrences, r.records, r.all_records) for r in p5.frequencies(df, "finding_id", p5.FIELDS).collect()}
    assert got == want
    marks = {(r.field_name, r.term): r.mark for r in p5.marked(df, "finding_id", p5.FIELDS).collect()}
    assert marks["rule_id", "hot"] == "common" and marks["rule_id", "lost"] == "rare" and marks["rule_id", "3"] is None


def test_empty(spark):
    df = spark.createDataFrame([], "finding_id bigint, rule_id string, cwe_id string, category string")
    assert p5.marked(df, "finding_id", p5.FIELDS).count() == 0
