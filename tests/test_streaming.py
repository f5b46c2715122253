import datetime as dt

from sieveline.operators.history import directories
from sieveline.sources import rules
from sieveline.streaming import streams


def test_match_stream_equals_batch(spark, tmp_path):
    files = spark.createDataFrame([(1, "a.py", "python", "eval(x)\neval(y)"), (2, "b.py", "python", "ok")], "file_id bigint, path string, language string, content string")
    files.repartition(2).write.parquet(str(tmp_path / "in"))
    table, _ = rules.compiled(spark.createDataFrame([("r", "python", "eval\\(")], "rule_id string, language string, pattern string"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), files.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    streams.run(streams.match_stream(stream, table), "hits")
    assert spark.table("hits").count() == 2


def test_counts_drop_what_is_too_late(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    spark.createDataFrame([(t, "a"), (t + dt.timedelta(hours=9), "a")], "ts timestamp, k string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), "ts timestamp, k string", 1)
    query = streams.run(streams.counts(stream, "ts", "k"), "counted", checkpoint=str(tmp_path / "cp"))
    assert query.lastProgress is not None
    assert [(r.window_start, r.events) for r in spark.table("counted").collect()] == [(t, 1)]


def test_directories_are_merged_batch_by_batch(spark, tmp_path):
    schema = "scan_id string, source_directory string, scanned_at string"
    rows = [("a", "/x", "2026-01-01T00:00:00Z"), ("b", "/x", "2026-01-03T00:00:00Z"), ("c", "/y", "2026-01-02T00:00:00Z")]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.file_stream(spark, str(tmp_path / "in"), schema)
        streams.upsert_directories(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        assert streams.read_directories(spark, str(tmp_path / "out")).count() == len({x[1] for x in rows[: k + 1]})
    got = sorted(map(tuple, streams.read_directories(spark, str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, directories(spark.createDataFrame(rows, schema)).collect()))
