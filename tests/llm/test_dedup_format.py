import json
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sieveline.llm import dedup_format as p1

SCHEMA = "record_id bigint, payload string, cells string, uses int, record string"


def canon(x):
    return " ".join(re.findall(r"[^\W_]+", (x or "").lower()))


def brute(records):
    seen, out = {}, []
    for rid, payload in sorted(r for r in records if r[1] is not None):
        try:
            doc = json.loads(payload)
        except ValueError:
            continue
        if not isinstance(doc, dict) or not doc:
            continue
        doc = {re.sub(r"[\W_]+", "", k.lower()): v for k, v in doc.items()}
        key = tuple(canon(doc.get(f)) for f in ("ruleid", "location", "codesnippet"))
        if key in seen:
            out.append((seen[key], rid))
        else:
            seen[key] = rid
    return sorted(out)


def found(spark, records):
    df = spark.createDataFrame([(i, p, "x", 1, "y") for i, p in records], SCHEMA)
    coded = p1.encode(p1.parse_records(df, "record_id", "payload"), "record_id", p1.FIELDS)
    return sorted((r.keep_id, r.copy_id) for r in p1.members(coded, p1.groups(coded)).collect())


def record(rule, loc, code, style=0):
    keys = [("rule_id", "location", "code_snippet"), ("RULE-ID", "Location", "Code Snippet"), ("ruleId", "LOCATION", "codeSnippet")][style]
    return json.dumps(dict(sorted(zip(keys, (rule, loc, code), strict=True), reverse=bool(style))))


def test_styles_nulls_and_broken(spark):
    long = "x" * 200_000
    data = [
        (5, record("a.b", "f.java:1:2", "x = 1;")), (2, record("A/B", " F.java#1.2 ", "X=1", 1)), (9, record("a.b", "f.java:1:2", "x = 1;")), (3, record("a.b", "f.java:1:3", "x = 1;", 2)),
        (4, None), (6, "{broken"), (7, "[]"), (8, "{}"), (10, record(None, None, None)), (11, '{"rule_id": ""}'), (12, record("é", "x", "Höhe")), (13, record("É", "x", "HÖHE", 1)), (14, record("q", "q", long)), (15, record("q", "q", long + " ")),
    ]
    assert found(spark, data) == brute(data) == [(2, 5), (2, 9), (10, 11), (12, 13), (14, 15)]


def test_empty(spark):
    assert found(spark, []) == []


def test_one_group_of_a_third(spark):
    data = [(i, record("hot", "h:1", "same", i % 3) if i % 3 else record(f"r{i}", "h:1", "z")) for i in range(300)]
    assert found(spark, data) == brute(data)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a b", "A-B", "ab", "", None]), st.sampled_from(["x:1", "X 1", "x"]), st.sampled_from(["p", "P;", "q"]), st.integers(0, 2)), max_size=12))
def test_against_brute_force(spark, items):
    data = [(i, record(*x)) for i, x in enumerate(items)]
    assert found(spark, data) == brute(data)
