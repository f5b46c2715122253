"""Problem 2: new batches against everything accepted, without reading the history's texts again.

The history is one bucketed table of hashes at a path of its own: of whole normalised contents (dependency_file) and of
"paragraphs", a paragraph being one rule's findings on `block` adjacent lines of one file. A hash has one row per append,
with the smallest finding_id of each of its lines, aggregated before anything is shuffled; so a rule, a file or a
fingerprint that holds a third of all rows is one row of each task. HashHistory(path) opens the table again in any later
session: a new batch reads hashes, never the findings, and what it adds is appended to the same buckets.

A batch brings the distinct hashes it is looked up by to the buckets they fall in; the history's side is neither shuffled
nor sorted again. Hashes many records share are looked up once, and hot ones go back to their records where those are.
Semi-joins tell full copies and how many of a record's paragraphs are known; the ids of the matches come from an inner join
of the same buckets. Two independent 64-bit hashes identify a content.

Defined cases: null dependency_file, rule_id, location, or a location without file and line, match nothing by the hash
that needs them; blank fingerprints are null; records with a null batch number form the last batch; an empty history or
an empty batch gives an empty result; of several accepted matches the smallest finding_id is reported.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.session import cut, hot_split_join, load, scratch_path, shuffle_width

TOLERANCE = 3


def normal_fingerprint(value: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")), F.lit(""))


def normal_rule(value: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")), r"^rules\.", ""), F.lit(""))


#: folders, file, then line and perhaps column as f:1:2, f:1, f(1,2), f(1) or f#L1
LOCATION = r"^\s*(?:.*[/\\])?([^/\\]+?)\s*(?:#L?(\d+)(?:[-:.,C#]+\d*)*|\(\s*(\d+)\s*(?:[,:;]\s*\d+\s*)?\)|:(\d+)(?::\d*)?)\s*$"


def with_keys(df: DataFrame) -> DataFrame:
    """finding_id, content hashes (c1, c2), place hashes' text and line of each record."""
    part = lambda k: F.regexp_extract("location", LOCATION, k)
    line = F.expr("try_cast(concat(l2, l3, l4) as bigint)")
    parts = df.select(
        "finding_id", *(["batch_no"] if "batch_no" in df.columns else []), normal_fingerprint(F.col("dependency_file")).alias("content"), normal_rule(F.col("rule_id")).alias("rule"),
        F.lower(part(1)).alias("file"), part(2).alias("l2"), part(3).alias("l3"), part(4).alias("l4"),
    )
    place = F.when(F.col("file") != "", F.concat_ws("\x00", F.col("rule"), F.col("file")))
    return parts.withColumn("line", line).withColumn("place", F.when(F.col("rule").isNotNull() & F.col("line").isNotNull(), place)).drop("file", "rule", "l2", "l3", "l4")


def _pair(*cols: Column) -> list[Column]:
    return [F.xxhash64(F.lit(17), *cols).alias("h1"), F.xxhash64(F.lit(71), *cols).alias("h2")]


def hashes(keyed: DataFrame, block: int) -> DataFrame:
    """One row per hash of a record: its content and the paragraph its place lies in; `slot` is the line's place there."""
    content = F.when(F.col("content").isNotNull(), F.struct(*_pair(F.lit("c"), F.col("content")), F.lit(0).cast("bigint").alias("slot")))
    place = F.when(F.col("place").isNotNull(), F.struct(*_pair(F.lit("p"), F.col("place"), F.floor(F.col("line") / block)), F.pmod("line", F.lit(block)).cast("bigint").alias("slot")))
    return keyed.select("finding_id", F.explode(F.array_compact(F.array(content, place))).alias("k")).select("finding_id", "k.h1", "k.h2", "k.slot")


def probes(keyed: DataFrame, block: int, tolerance: int) -> DataFrame:
    """The hashes a record is looked up by: its content, and every paragraph within the tolerance of its line.

    low and high are the slots of a paragraph that are near enough; kind tells contents, a record's own paragraph, and others.
    """
    kind = "array<struct<h1:bigint,h2:bigint,low:int,high:int,kind:string>>"
    slots = lambda low, high, name: [low.cast("int").alias("low"), high.cast("int").alias("high"), name.alias("kind")]
    content = F.when(F.col("content").isNotNull(), F.array(F.struct(*_pair(F.lit("c"), F.col("content")), *slots(F.lit(0), F.lit(0), F.lit("content")))))
    first, last = F.floor((F.col("line") - tolerance) / block), F.floor((F.col("line") + tolerance) / block)
    own = F.floor(F.col("line") / block)
    near = lambda b: slots(F.greatest(F.lit(0), F.col("line") - tolerance - b * block), F.least(F.lit(block - 1), F.col("line") + tolerance - b * block), F.when(b == own, "own").otherwise("near"))
    places = F.when(F.col("place").isNotNull(), F.transform(F.sequence(first, last), lambda b: F.struct(*_pair(F.lit("p"), F.col("place"), b), *near(b))))
    none = F.array().cast(kind)
    return keyed.select("finding_id", F.explode(F.concat(F.coalesce(content, none), F.coalesce(places, none))).alias("k")).select("finding_id", "k.*")


class HashHistory:
    """Hashes of all accepted records in a bucketed table at `path`, made by the first append and opened by later ones.

    append() adds accepted records, match() finds each record's smallest accepted match, coverage() what is known of each.
    """

    KEYS = ["h1", "h2"]

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, tolerance: int = TOLERANCE):
        self.spark, self.path = spark, path or scratch_path(spark, "history")
        self.table = "hashes_" + hashlib.md5(self.path.encode()).hexdigest()[:16]
        held = self._about()
        self.buckets, self.tolerance = (held["buckets"], held["tolerance"]) if held else (buckets or shuffle_width(spark), tolerance)
        self.block = self.tolerance + 1
        self.made = held is not None
        if self.made:
            self._register()

    def _file(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_about.json")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _about(self) -> dict | None:
        at, fs = self._file()
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _register(self) -> None:
        self.spark.sql(f"create table if not exists {self.table} (h1 bigint, h2 bigint, ids array<bigint>) using parquet clustered by (h1, h2) sorted by (h1, h2) into {self.buckets} buckets location '{self.path}'")

    def append(self, keyed: DataFrame) -> None:
        """Add the hashes of accepted records (finding_id, content, place, line), a row for each."""
        if not self.made:
            self._register()
            at, fs = self._file()
            out = fs.create(at, True)
            out.write(json.dumps({"buckets": self.buckets, "tolerance": self.tolerance}).encode())
            out.close()
            self.made = True
        least = [F.min(F.when(F.col("slot") == k, F.col("finding_id"))).alias(f"m{k}") for k in range(self.block)]
        # Grouped by the buckets' own columns: combined in each task, shuffled once, written as it arrives.
        rows = hashes(keyed, self.block).groupBy(*self.KEYS).agg(*least).select(*self.KEYS, F.array(*(F.col(f"m{k}") for k in range(self.block))).alias("ids"))
        rows.write.insertInto(self.table)

    def close(self) -> None:
        """Forget the table's name in this session; its files stay."""
        self.spark.sql(f"drop table if exists {self.table}")

    def _sought(self, keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(each record's probes, the distinct ones with the number of records `n` that share them)."""
        sought = cut(probes(keyed, self.block, self.tolerance), "probes")
        return sought, sought.groupBy(*self.KEYS, "low", "high").agg(F.count("*").alias("n"))

    def _hits(self, distinct: DataFrame) -> DataFrame:
        """The distinct probes with the smallest id of each row of theirs in the buckets."""
        near = F.array_min(F.slice("ids", F.col("low") + 1, F.col("high") - F.col("low") + 1))
        return distinct.join(self.spark.table(self.table), self.KEYS).select(*self.KEYS, "low", "high", "n", near.alias("accepted_id")).filter("accepted_id is not null")

    def match(self, keyed: DataFrame) -> DataFrame:
        """(finding_id, accepted_id) of every record that matches an accepted one, with the smallest it matches."""
        if not self.made:
            return keyed.select("finding_id", F.col("finding_id").alias("accepted_id")).limit(0)
        sought, distinct = self._sought(keyed)
        # Appends may each have a row of a hash.
        best = cut(self._hits(distinct).groupBy(*self.KEYS, "low", "high").agg(F.max("n").alias("n"), F.min("accepted_id").alias("accepted_id")), "hits")
        return hot_split_join(sought, best, [*self.KEYS, "low", "high"], "n").groupBy("finding_id").agg(F.min("accepted_id").alias("accepted_id"))

    def coverage(self, keyed: DataFrame) -> DataFrame:
        """(finding_id, full_copy, paragraphs, known_paragraphs) of every record: is its content known, and of the paragraphs
        within its tolerance, how many hold accepted records. Bucket-local semi-joins: nothing of the history is moved."""
        sought, distinct = self._sought(keyed)
        known = distinct.limit(0) if not self.made else distinct.join(self.spark.table(self.table).select(*self.KEYS), self.KEYS, "left_semi")
        found = hot_split_join(sought, cut(known.select(*self.KEYS, "low", "high", "n"), "known-hashes"), [*self.KEYS, "low", "high"], "n").select("finding_id", "kind", F.lit(1).alias("hit"))
        every = sought.select("finding_id", "kind", F.lit(0).alias("hit")).unionByName(found)
        sums = every.groupBy("finding_id").agg(F.max(F.when(F.col("kind") == "content", F.col("hit"))).alias("c"), F.count_if((F.col("kind") != "content") & (F.col("hit") == 0)).alias("paragraphs"), F.count_if((F.col("kind") != "content") & (F.col("hit") == 1)).alias("known_paragraphs"))
        told = keyed.select("finding_id").join(sums, "finding_id", "left")
        return told.select("finding_id", (F.coalesce("c", F.lit(0)) == 1).alias("full_copy"), F.coalesce("paragraphs", F.lit(0)).cast("bigint").alias("paragraphs"), F.coalesce("known_paragraphs", F.lit(0)).cast("bigint").alias("known_paragraphs"))


def dedup_batches(history: DataFrame | None, incoming: DataFrame, tolerance: int = TOLERANCE, index: HashHistory | None = None) -> DataFrame:
    """(accepted_id, incoming_id) of the incoming records that match the history or what earlier batches added to it.

    index: the history's hashes as an earlier run left them; then history may be None and isn't read, and what this run
    accepts is appended. All batches are held against the history at once; only what it doesn't know goes through the
    batches one by one, against the hashes earlier batches added. The driver sees the batch numbers, nothing else.
    """
    spark = incoming.sparkSession
    keyed = cut(with_keys(incoming.withColumn("batch_no", F.coalesce(F.col("batch_no").cast("bigint"), F.lit(2**62)))), "incoming-keys")
    base = index or HashHistory(spark, tolerance=tolerance)
    if history is not None and not base.made:
        base.append(with_keys(history))
    known = cut(base.match(keyed), "known")
    rest = cut(keyed.join(known, "finding_id", "left_anti"), "unknown")
    added, found, fresh = HashHistory(spark, tolerance=base.tolerance), [known], []
    numbers = [r[0] for r in rest.select("batch_no").distinct().orderBy("batch_no").toLocalIterator()]
    for k, number in enumerate(numbers):
        batch = rest.filter(F.col("batch_no") == number)
        if k:
            found.append(cut(added.match(batch), "matched"))
            batch = batch.join(found[-1], "finding_id", "left_anti")
        fresh.append(batch)
        if k + 1 < len(numbers):
            added.append(batch)
    if index is not None and fresh:
        index.append(reduce(DataFrame.unionByName, fresh))
    for own in (added, *([] if index else [base])):
        own.close()
    return reduce(DataFrame.unionByName, found).select("accepted_id", F.col("finding_id").alias("incoming_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_batches(load(spark, sf_dir, "findings"), load(spark, sf_dir, "incoming_findings"))


def p2_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per batch: records, those already known, and those accepted as new."""
    incoming = load(spark, sf_dir, "incoming_findings")
    found = p2_found(spark, sf_dir).select(F.col("incoming_id").alias("finding_id"), F.lit(1).alias("hit"))
    return incoming.join(found, "finding_id", "left").groupBy("batch_no").agg(F.count("*").alias("records"), F.count("hit").alias("known"), F.count_if(F.col("hit").isNull()).alias("accepted"))


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each incoming record: is it a full copy of an accepted finding, and how many of the paragraphs around it are known."""
    index = HashHistory(spark)
    index.append(with_keys(load(spark, sf_dir, "findings")))
    out = cut(index.coverage(with_keys(load(spark, sf_dir, "incoming_findings"))), "coverage")
    index.close()
    return out


QUERIES = {"p2_found": p2_found, "p2_batches": p2_batches, "p2_coverage": p2_coverage}

_KEYED = r"""
select finding_id, {0} as batch_no, nullif(lower(trim(dependency_file, ' ' || chr(9) || chr(10) || chr(13))), '') as fp, nullif(regexp_replace(lower(trim(rule_id, ' ' || chr(9) || chr(10) || chr(13))), '^rules\.', ''), '') as rule,
  nullif(lower(regexp_extract(location, p, 1)), '') as file, try_cast(concat(regexp_extract(location, p, 2), regexp_extract(location, p, 3), regexp_extract(location, p, 4)) as bigint) as line
from {1}, (select '^\s*(?:.*[/\\])?([^/\\]+?)\s*(?:#L?(\d+)(?:[-:.,C#]+\d*)*|\(\s*(\d+)\s*(?:[,:;]\s*\d+\s*)?\)|:(\d+)(?::\d*)?)\s*$' as p)
"""
#: What the history alone knows: fingerprints, and places by their blocks of four lines.
SQL = {
    "p2_coverage": f"""with h as ({_KEYED.format('0', 'findings')}), i as ({_KEYED.format('batch_no', 'incoming_findings')}), fps as (select distinct fp from h where fp is not null),
      blocks as (select distinct rule, file, floor(line / 4.0)::bigint as b from h where rule is not null and file is not null and line is not null),
      near as (select finding_id, rule, file, unnest(generate_series(floor((line - 3) / 4.0)::bigint, floor((line + 3) / 4.0)::bigint)) as b from i where rule is not null and file is not null and line is not null),
      n as (select finding_id, count(*) as paragraphs, count(blocks.b) as known_paragraphs from near left join blocks using (rule, file, b) group by 1)
      select i.finding_id, i.fp is not null and exists (select 1 from fps where fps.fp = i.fp) as full_copy, coalesce(paragraphs, 0) as paragraphs, coalesce(known_paragraphs, 0) as known_paragraphs from i left join n using (finding_id)""",
}
