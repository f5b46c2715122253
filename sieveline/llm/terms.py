"""Problem 5: how often every term occurs, and in how many records.

Vertical layout. Each task turns its records into one compressed bitmap of record identifiers per (field, term,
identifier block) beside an occurrence counter; blocks are united across tasks and the document frequency is the
cardinality. A block covers 65,536 identifiers, so no bitmap exceeds 8 KB and the rows of a term that holds a third of
all records are spread over as many blocks as its identifiers span.

Defined cases: null fields and texts without letters or digits have no terms; rows that share an identifier are one
record; rows with a null identifier count as a record each; an empty table gives an empty result. Extra columns are
ignored whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.session import cut, load, shuffle_width

BLOCK_BITS = 16
DENSE_FROM = 4096
POSTING = "field_name string, term string, block bigint, bitmap binary, occurrences bigint, unkeyed bigint"
#: The pseudo field whose only term is in every record; its cardinality is the number of records.
EVERY = "*"


def pack(low: np.ndarray) -> bytes:
    """Sorted unique 16-bit values as a container: a list when sparse, 8 KB of bits when dense."""
    if len(low) < DENSE_FROM:
        return low.astype("<u2").tobytes()
    bits = np.zeros(1 << BLOCK_BITS, dtype=np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(container: bytes) -> np.ndarray:
    """The sorted 16-bit values of a container."""
    if len(container) < 2 * DENSE_FROM:
        return np.frombuffer(container, dtype="<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(container, dtype=np.uint8), bitorder="little")).astype("<u2")


def union(containers: Sequence[bytes]) -> bytes:
    """The union of containers of one block."""
    if len(containers) == 1:
        return containers[0]
    return pack(np.unique(np.concatenate([unpack(c) for c in containers])))


def cardinality(container: bytes) -> int:
    if len(container) < 2 * DENSE_FROM:
        return len(container) // 2
    return int(np.bitwise_count(np.frombuffer(container, dtype=np.uint64)).sum())


def _letters_or_digits(value: str) -> list[str]:
    out: list[str] = []
    run: list[str] = []
    for ch in value.lower():
        if ch.isalnum():
            run.append(ch)
        elif run:
            out.append("".join(run))
            run = []
    if run:
        out.append("".join(run))
    return out


def _posting_rows(fields: Sequence[str]):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            keyed = np.asarray(ids.is_valid())
            record = np.asarray(ids.fill_null(0)).astype(np.int64)
            held: dict[tuple[str, str], list[np.ndarray]] = defaultdict(list)
            times: dict[tuple[str, str], int] = defaultdict(int)
            held[EVERY, ""].append(np.arange(batch.num_rows))
            for k, field in enumerate(fields, 1):
                coded = batch.column(k).dictionary_encode()
                codes = np.asarray(coded.indices.fill_null(-1)).astype(np.int64)
                order = np.argsort(codes, kind="stable")
                starts = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
                for v, value in enumerate(coded.dictionary.to_pylist()):
                    terms = known.get(value)
                    if terms is None:
                        if len(known) >= 50_000:
                            known.clear()
                        terms = known[value] = _letters_or_digits(value)
                    rows = order[starts[v] : starts[v + 1]]
                    for term in terms:
                        times[field, term] += len(rows)
                    for term in dict.fromkeys(terms):
                        held[field, term].append(rows)
            cols: list[list] = [[], [], [], [], [], []]
            for (field, term), parts in held.items():
                rows = np.concatenate(parts)
                mine = keyed[rows]
                have = np.unique(record[rows[mine]])
                blocks = have >> BLOCK_BITS
                cuts = np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1)) if len(have) else []
                ends = [*cuts[1:], len(have)] if len(have) else []
                counts = {"occurrences": times[field, term], "unkeyed": int(len(rows) - mine.sum())}
                for a, b in zip(cuts, ends, strict=True):
                    low = (have[a:b] & 0xFFFF).astype("<u2")
                    for col, x in zip(cols, (field, term, int(blocks[a]), pack(low), counts["occurrences"], counts["unkeyed"]), strict=True):
                        col.append(x)
                    counts = dict.fromkeys(counts, 0)  # the counters go with the first block
                if not len(have):
                    for col, x in zip(cols, (field, term, 0, b"", counts["occurrences"], counts["unkeyed"]), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["field_name", "term", "block", "bitmap", "occurrences", "unkeyed"])

    return build


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite the containers of equal (field, term, block), which arrive next to each other."""
    names = ["field_name", "term", "records", "occurrences"]
    types = (pa.string(), pa.string(), pa.int64(), pa.int64())
    key, containers, occurrences, unkeyed = None, [], 0, 0
    out: list[list] = [[], [], [], []]

    def close() -> None:
        if key is not None:
            for col, x in zip(out, (key[0], key[1], cardinality(union(containers)) + unkeyed, occurrences), strict=True):
                col.append(x)

    for batch in batches:
        for field, term, block, bitmap, n, u in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (field, term, block) != key:
                close()
                key, containers, occurrences, unkeyed = (field, term, block), [], 0, 0
            containers.append(bitmap)
            if len(containers) == 64:
                containers = [union(containers)]
            occurrences += n
            unkeyed += u
        if len(out[0]) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
            out = [[], [], [], []]
    close()
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)


def postings(df: DataFrame, record_id: str, fields: dict[str, str]) -> DataFrame:
    """Partial postings of every (field, term, block). fields: name in the result -> column or expression."""
    cols = [F.col(record_id).cast("bigint").alias("_record"), *(F.expr(e).cast("string").alias(f"_f{k}") for k, e in enumerate(fields.values()))]
    return df.select(*cols).mapInArrow(_posting_rows(list(fields)), POSTING)


def frequencies(df: DataFrame, record_id: str, fields: dict[str, str]) -> DataFrame:
    """(field_name, term, occurrences, records, all_records) of every distinct term of every field."""
    spark = df.sparkSession
    merged = (
        postings(df, record_id, fields)
        .repartition(shuffle_width(spark), "field_name", "term", "block")
        .sortWithinPartitions("field_name", "term", "block")
        .mapInArrow(_merge, "field_name string, term string, records bigint, occurrences bigint")
    )
    totals = merged.groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    totals = cut(totals, "term-totals")
    # One row, whatever the data.
    n = totals.filter(F.col("field_name") == EVERY).agg(F.coalesce(F.max("records"), F.lit(0)).alias("all_records"))
    return totals.filter(F.col("field_name") != EVERY).join(F.broadcast(n))


def marked(df: DataFrame, record_id: str, fields: dict[str, str], rare_below: int = 3, common_above: float = 0.15) -> DataFrame:
    """The frequencies with a mark: rare under `rare_below` records, common above that share of all records, else null."""
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * F.col("all_records"), "common")
    return frequencies(df, record_id, fields).withColumn("mark", mark)


FIELDS = {"rule_id": "rule_id", "cwe_id": "cwe_id", "category": "category"}


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(load(spark, sf_dir, "findings"), "finding_id", FIELDS)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_terms(spark, sf_dir).filter("mark is not null").select("field_name", "term", "mark")


QUERIES = {"p5_terms": p5_terms, "p5_found": p5_found}

_TERMS = """
with terms as (
  select finding_id, f.field_name, unnest(regexp_extract_all(lower(f.v), '[\\p{L}\\p{N}]+')) as term
  from (select finding_id, unnest([{'field_name': 'rule_id', 'v': rule_id}, {'field_name': 'cwe_id', 'v': cwe_id}, {'field_name': 'category', 'v': category}]) as f from findings)
), n as (select count(*) as all_records from findings),
totals as (select field_name, term, count(*) as occurrences, count(distinct finding_id) as records from terms group by all)
select field_name, term, occurrences, records, all_records,
       case when records < 3 then 'rare' when records > 0.15 * all_records then 'common' end as mark
from totals, n
"""
SQL = {"p5_terms": _TERMS, "p5_found": f"select field_name, term, mark from ({_TERMS}) where mark is not null"}
