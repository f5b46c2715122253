import random
import re

from sieveline.llm import dedup_history as p2

H = "finding_id bigint, rule_id string, location string, dependency_file string, h1 bigint, line string"
N = "finding_id bigint, batch_no int, rule_id string, location string, dependency_file string, place string"


def key(loc):
    m = re.match(r"^\s*(?:.*[/\\])?([^/\\]+?)\s*(?:#L?(\d+).*|\((\d+).*|:(\d+)(?::\d*)?)\s*$", loc or "")
    return (m[1].lower(), int(m[2] or m[3] or m[4])) if m else None


def rule(r):
    r = (r or "").strip().lower()
    return (r[6:] if r.startswith("rules.") else r) or None


def brute(history, incoming):
    accepted = [(i, rule(r), key(loc), (d or "").strip().lower() or None) for i, r, loc, d in history]
    out = []
    for b in sorted({x[1] for x in incoming}, key=lambda x: (x is None, x)):
        fresh = []
        for i, _, r, loc, d in (x for x in incoming if x[1] == b):
            me = (i, rule(r), key(loc), (d or "").strip().lower() or None)
            hits = [a[0] for a in accepted if (me[3] and a[3] == me[3]) or (me[1] and me[2] and a[1] == me[1] and a[2] and a[2][0] == me[2][0] and abs(a[2][1] - me[2][1]) <= 3)]
            if hits:
                out.append((min(hits), i))
            else:
                fresh.append(me)
        accepted += fresh
    return sorted(out)


def found(spark, history, incoming):
    h = spark.createDataFrame([(*x, 1, "z") for x in history], H)
    n = spark.createDataFrame([(*x, "z") for x in incoming], N)
    return sorted(tuple(r) for r in p2.dedup_batches(h, n).collect())


def test_cases(spark):
    history = [(1, "rules.a.b", "F.java:10:2", "AB"), (2, "A.B", "x/y/f.java:11", None), (3, None, "f.java:10:1", "cd"), (4, "a.b", None, None), (5, "a.b", "f.java:10:2", "ab")]
    incoming = [
        (10, 1, " a.B ", "src\\f.JAVA#L14", None), (11, 1, "a.b", "f.java(15,2)", None), (12, 1, None, None, " ab "), (13, 1, "a.b", "f.java", None), (14, 1, None, None, None),
        (20, 2, "a.b", "f.java:17", None), (21, 2, "q", "g.py:1", "zz"), (30, 3, "q", "g.py:4", None), (31, 3, "q", "g.py:5", "zz"), (40, None, "q", "g.py:7:1", None),
    ]
    assert found(spark, history, incoming) == brute(history, incoming)


def test_empty_sides(spark):
    assert found(spark, [], []) == []
    assert found(spark, [], [(1, 1, "a", "f:1", "x"), (2, 2, "a", "f:2", "y")]) == [(1, 2)]


def test_random_with_a_hot_key(spark):
    r = random.Random(3)
    make = lambda i: (i, r.choice(["a", "rules.a", "B", None]), f"{r.choice(['f.py', 'd/F.py', 'g.py'])}:{r.randrange(40)}:{r.randrange(9)}", r.choice(["hot", "hot", f"d{r.randrange(30)}", None]))
    history = [make(i) for i in range(1, 40)]
    incoming = [(i, r.randrange(1, 6), *make(i)[1:]) for i in range(1000, 1060)]
    incoming = [(i, b, q, loc, None if d == "hot" else d) for i, b, q, loc, d in incoming]
    assert found(spark, history, incoming) == brute(history, incoming)


def test_a_fingerprint_holds_a_third_of_what_comes_in(spark):
    r = random.Random(9)
    history = [(i, "a", f"f.py:{r.randrange(60)}:1", f"d{i}") for i in range(1, 30)]
    incoming = [(i, 1 + i % 3, r.choice(["a", "b"]), f"f.py:{r.randrange(90)}", r.choice(["Hot", "d3", f"n{i}"])) for i in range(100, 190)]
    assert found(spark, history, incoming) == brute(history, incoming)


def test_a_later_session_reads_hashes_only(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    history = [(1, "a", "f:1", "x"), (2, "b", "g:9", None)]
    first = [(10, 1, "c", "h:5", "y"), (11, 1, "a", "f:3", None)]
    h = spark.createDataFrame([(*x, 1, "z") for x in history], H)
    n = lambda rows: spark.createDataFrame([(*x, "z") for x in rows], N)
    index = p2.HashHistory(spark, path, buckets=3)
    assert sorted(map(tuple, p2.dedup_batches(h, n(first), index=index).collect())) == [(1, 11)]
    index.close()
    again = p2.HashHistory(spark, path, buckets=7)
    assert again.made and again.buckets == 3
    out = p2.dedup_batches(None, n([(20, 1, None, None, "Y "), (21, 1, "b", "x/g:6", None), (22, 1, "c", "h:9", None)]), index=again)
    assert sorted(map(tuple, out.collect())) == [(2, 21), (10, 20)]
    assert sorted(map(tuple, p2.dedup_batches(None, n([(30, 1, "c", "h:12", None)]), index=again).collect())) == [(22, 30)]


def test_coverage(spark):
    index = p2.HashHistory(spark)
    assert index.match(p2.with_keys(spark.createDataFrame([(1, "a", "f:1", "x", 1, "z")], H))).count() == 0
    index.append(p2.with_keys(spark.createDataFrame([(1, "a", "f:5", "x", 1, "z")], H)))
    rows = p2.with_keys(spark.createDataFrame([(2, "a", "f:6", "X", 1, "z"), (3, "a", "f:3", None, 1, "z"), (4, None, None, None, 1, "z")], H))
    assert sorted(map(tuple, index.coverage(rows).collect())) == [(2, True, 3, 1), (3, False, 2, 1), (4, False, 0, 0)]


def test_the_history_is_combined_before_it_is_shuffled(spark):
    plan = p2.hashes(p2.with_keys(spark.createDataFrame([(1, "a", "f:1", "x", 1, "z")], H)), 4).groupBy("h1", "h2").agg(p2.F.min("finding_id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(h1") < plan.rindex("partial_min")


def test_append_is_history_for_the_next(spark):
    index = p2.HashHistory(spark)
    index.append(p2.with_keys(spark.createDataFrame([(1, "a", "f:1", "x", 1, "z")], H)))
    new = p2.with_keys(spark.createDataFrame([(2, "b", "g:1", "y", 1, "z")], H))
    assert index.match(new).count() == 0
    index.append(new)
    later = p2.with_keys(spark.createDataFrame([(3, "b", "g:3", None, 1, "z"), (4, "a", "f:2", None, 1, "z")], H))
    assert sorted(map(tuple, index.match(later).collect())) == [(3, 2), (4, 1)]


def test_history_side_is_not_shuffled(spark):
    index = p2.HashHistory(spark)
    index.append(p2.with_keys(spark.createDataFrame([(1, "a", "f:1", "x", 1, "z")], H)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, distinct = index._sought(p2.with_keys(spark.createDataFrame([(3, "b", "g:3", None, 1, "z")], H)))
        plan = index._hits(distinct)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and index.table in plan
    history = plan[plan.index("Bucketed: true") - 2000 :] if plan.index("Bucketed: true") > 2000 else plan
    assert "SortMergeJoin" in plan and history.count("Exchange hashpartitioning(h1") <= 2
