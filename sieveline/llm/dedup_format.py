"""Problem 1: records that differ only in formatting.

Every column is dictionary-encoded: each distinct raw value is canonicalised once, each distinct canonical value gets
an integer, and a record becomes the sorted tuple of its (field, value) integers. Equal tuples are equal records, so the
grouping moves a few integers per record instead of its texts.

Defined cases: a null payload, or one that is no JSON object, is no record; a missing or null field has the canonical
value '' like an empty one; of two spellings of one key the later counts; an empty table gives an empty result. Ties do
not arise: the smallest record_id of a group is kept. Groups may be of any size: they are only counted and minimised
(with partial aggregation), and the lookups back to their members leave hot keys in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.session import cut, hot_split_join, load

FIELDS = ("rule_id", "location", "code_snippet")


def canonical(value: Column) -> Column:
    """Letter case ignored; runs of what is neither letter nor digit are one separator, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def parse_records(exports: DataFrame, record_id: str, payload: str, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(record_id, one column per field) of the JSON objects, whatever the spelling of their keys."""
    plain = {f.replace("_", ""): f for f in fields}
    entries = F.map_entries(F.from_json(F.col(payload), "map<string,string>"))
    rows = exports.select(F.col(record_id).alias("record_id"), entries.alias("e")).filter("e is not null and size(e) > 0")
    rows = rows.select("record_id", F.transform("e", lambda e: F.struct(F.regexp_replace(F.lower(e["key"]), r"[^\p{L}\p{N}]+", "").alias("name"), e["value"].alias("value"))).alias("e"))

    def last(name: str) -> Column:
        return F.try_element_at(F.filter("e", lambda e: e["name"] == name), F.lit(-1))["value"]

    return rows.select("record_id", *(last(n).alias(f) for n, f in plain.items()))


def encode(records: DataFrame, record_id: str, fields: Sequence[str]) -> DataFrame:
    """(record_id, cells): each record as the sorted tuple of the integers of its canonical field values."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("raw")) for k, f in enumerate(fields))))
    cells = records.select(F.col(record_id).alias("record_id"), pairs.alias("c")).select("record_id", "c.field", "c.raw")
    raw = cells.groupBy("field", "raw").agg(F.count("*").alias("uses")).withColumn("canon", canonical(F.col("raw")))
    raw = cut(raw, "raw-values")
    # Written once, so an identifier never changes when a task is repeated.
    ids = cut(raw.groupBy("field", "canon").agg(F.count("*").alias("spellings")).withColumn("value_id", F.monotonically_increasing_id()), "value-ids")
    dictionary = hot_split_join(raw, ids, ["field", "canon"], "spellings").select("field", "raw", "uses", "value_id")
    coded = hot_split_join(cells, cut(dictionary, "dictionary"), ["field", "raw"], "uses")
    return coded.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("field", "value_id"))).alias("t")).select("record_id", F.col("t.value_id").alias("cells"))


def groups(coded: DataFrame) -> DataFrame:
    """One row per distinct record: its tuple, the smallest record_id and the number of copies."""
    return coded.groupBy("cells").agg(F.min("record_id").alias("keep_id"), F.count("*").alias("copies"))


def members(coded: DataFrame, found: DataFrame) -> DataFrame:
    """(keep_id, copy_id) of every record but the kept ones."""
    several = found.filter("copies > 1")
    return hot_split_join(coded, several, ["cells"], "copies").filter("record_id <> keep_id").select("keep_id", F.col("record_id").alias("copy_id"))


def _coded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = cut(parse_records(load(spark, sf_dir, "finding_exports"), "record_id", "payload"), "records")
    return records, cut(encode(records, "record_id", FIELDS), "coded")


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct finding once, as its first record wrote it, with its number of copies."""
    records, coded = _coded(spark, sf_dir)
    kept = groups(coded).select(F.col("keep_id").alias("record_id"), "copies")
    return records.join(kept, "record_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, coded = _coded(spark, sf_dir)
    return members(coded, cut(groups(coded), "groups"))


QUERIES = {"p1_records": p1_records, "p1_found": p1_found}

_CANON = "trim(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_RECORDS = f"""
with entries as (
  select record_id, unnest(json_keys(payload::json)) as k, payload::json as p from finding_exports
  where payload is not null and json_valid(payload) and json_type(payload::json) = 'OBJECT'
), plain as (
  select record_id, regexp_replace(lower(k), '[^\\p{{L}}\\p{{N}}]+', '', 'g') as n, p ->> ('$."' || k || '"') as v from entries
), records as (
  select record_id, max(v) filter (n = 'ruleid') as rule_id, max(v) filter (n = 'location') as location, max(v) filter (n = 'codesnippet') as code_snippet
  from plain group by record_id
), grouped as (
  select *, min(record_id) over g as keep_id, count(*) over g as copies from records
  window g as (partition by {_CANON.format('rule_id')}, {_CANON.format('location')}, {_CANON.format('code_snippet')})
)
"""
SQL = {
    "p1_records": _RECORDS + "select record_id, rule_id, location, code_snippet, copies from grouped where record_id = keep_id",
    "p1_found": _RECORDS + "select keep_id, record_id as copy_id from grouped where record_id <> keep_id",
}
