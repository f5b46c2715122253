"""Problem 7: the corpus as token ids of a public byte-level BPE tokenizer.

A partition's texts are cut into words by the tokenizer's pattern; words not seen before go to DuckDB as rows
(word, position, token). A recursive query joins neighbours with the merge table and contracts each word's leftmost pair
of minimum rank until no pair is left; an ordered aggregation gathers each word's ids. A word is encoded once per worker,
however often it occurs.

All words are contracted by the same recursive query, which holds a word's current tokens only: a step replaces the rows of
the step before (a recursion with a key), so a word of any length needs memory for its tokens, not for all its steps. In a
step every word merges all its pairs of minimum rank that don't overlap, from the left; that gives what merging the leftmost
one at a time gives, since a pair made by a merge ranks behind it.

Defined cases: null and empty texts have an empty list; special tokens' strings are ordinary text; texts and words of any
length are encoded whole; a document delivered twice has two rows.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.session import load

TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
#: Token rows of one recursive query; only a word longer than that is more.
QUERY_ROWS = 200_000
KEPT_WORDS = 300_000
#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CONTRACT = """
with recursive state(word, pos, tok, nxt) using key (word, pos) as (
  select word, pos, tok, lead(pos) over (partition by word order by pos) from seed
  union all
  select word, unnest([pos, nxt]), unnest([made, null]), unnest([far, null])
  from (
    select *, row_number() over (partition by word, run order by pos) % 2 = 1 as hit
    from (
      select *, nth - row_number() over (partition by word order by pos) as run
      from (
        select a.word, a.pos, a.nxt, a.far, a.nth, m.made, m.rank, min(m.rank) over (partition by a.word) as best
        from (
          select *, row_number() over w as nth, lead(tok) over w as following, lead(nxt) over w as far
          from recurring.state where tok is not null and word in (select word from state) window w as (partition by word order by pos)
        ) a join merges m on m.l = a.tok and m.r = a.following
      ) where rank = best
    )
  ) where hit
)
select word, list(tok order by pos) as ids from state where tok is not null group by word
"""

DECODE = "select item, string_agg(hex(bytes), '' order by pos) as text from given join texts using (id) group by item"


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_merges(name: str, folder: str) -> tuple[list[int], dict[str, list[int]], dict[int, bytes]]:
    """(id of each byte, merge table as columns, bytes of each id) of a vocabulary file."""
    table: dict[str, list[int]] = {"l": [], "r": [], "rank": [], "made": []}
    path = os.path.join(folder, name)
    if os.path.exists(f"{path}.json"):
        with open(f"{path}.json", encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = _byte_letters(), model["vocab"]
        byte_ids = [0] * 256
        for letter, b in letters.items():
            byte_ids[b] = vocab[letter]
        for rank, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]):
            for col, x in zip(table.values(), (vocab[a], vocab[b], rank, vocab[a + b]), strict=True):
                col.append(x)
        return byte_ids, table, {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in vocab.items()}
    with open(f"{path}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            if token[:k] in ranks and token[k:] in ranks:
                for col, x in zip(table.values(), (ranks[token[:k]], ranks[token[k:]], rank, rank), strict=True):
                    col.append(x)
    return [ranks[bytes([b])] for b in range(256)], table, {i: t for t, i in ranks.items()}


class Encoder:
    """The merges of one tokenizer in a DuckDB of its own, and the words encoded so far."""

    def __init__(self, name: str, folder: str):
        self.byte_ids, merges, texts = read_merges(name, folder)
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})  # a query holds its words' tokens only, nothing is spilled
        rows = pa.table({k: pa.array(v, pa.int32()) for k, v in merges.items()})
        self.db.register("merge_rows", rows)
        self.db.register("text_rows", pa.table({"id": pa.array(list(texts), pa.int32()), "bytes": pa.array(list(texts.values()), pa.binary())}))
        self.db.execute("create table texts as from text_rows")
        self.db.execute("create table merges as select l, r, min(rank) as rank, arg_min(made, rank) as made from merge_rows group by l, r")

    def _seed(self, words: list[bytes]) -> None:
        word = [k for k, w in enumerate(words) for _ in w]
        pos = [p for w in words for p in range(len(w))]
        tok = [self.byte_ids[b] for w in words for b in w]
        self.db.register("seed", pa.table({"word": pa.array(word, pa.int32()), "pos": pa.array(pos, pa.int32()), "tok": pa.array(tok, pa.int32())}))

    def _contract(self, words: list[str]) -> None:
        self._seed([w.encode("utf-8", "replace") for w in words])
        for k, ids in self.db.execute(CONTRACT).fetchall():
            self.known[words[k]] = ids

    def learn(self, words: set[str]) -> None:
        """Encode the words not seen before, in queries of bounded size (a longer word has one of its own)."""
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > KEPT_WORDS:
            self.known = {w: self.known[w] for w in words if w in self.known}
        part: list[str] = []
        rows = 0
        for w in sorted(fresh, key=len):
            n = len(w.encode("utf-8", "replace"))
            if part and rows + n > QUERY_ROWS:
                self._contract(part)
                part, rows = [], 0
            part.append(w)
            rows += n
        if part:
            self._contract(part)

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text; texts are cut and looked up in groups, so that no more than a group is held as words."""
        group: list[list[str]] = []
        held = 0
        for text in texts:
            cut = self.pattern.findall(text) if text else []
            group.append(cut)
            held += len(cut)
            if held >= 200_000:
                yield from self._ids(group)
                group, held = [], 0
        yield from self._ids(group)

    def _ids(self, group: list[list[str]]) -> Iterator[list[int]]:
        self.learn({w for cut in group for w in cut})
        known = self.known
        for cut in group:
            ids: list[int] = []
            for w in cut:
                ids += known[w]
            yield ids

    def decode(self, ids: list[int]) -> str:
        return self.decode_all([ids])[0]

    def decode_all(self, lists: Sequence[Sequence[int]]) -> list[str]:
        """The texts of lists of ids, put together by an ordered aggregation over (list, position, id) rows."""
        sizes = [len(x) for x in lists]
        self.db.register("given", pa.table({"item": pa.array(np.repeat(np.arange(len(lists)), sizes)), "pos": pa.array(np.concatenate([np.arange(n) for n in sizes] or [np.zeros(0, np.int64)])), "id": pa.array([i for x in lists for i in x], pa.int32())}))
        out = [""] * len(lists)
        for k, text in self.db.execute(DECODE).fetchall():
            out[k] = bytes.fromhex(text).decode("utf-8", "replace")
        return out


@lru_cache(maxsize=2)
def encoder(name: str, folder: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(name, folder)


def encode(df: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids array<int>) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for batch in batches:
            ids = list(enc.encode(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    return df.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(df: DataFrame, text: str, tokenizer: str = TOKENIZER, folder: str = TOKENIZERS, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The kept columns and the number of tokens of every document."""
    kept = df.select(*keep)
    types = {f.name: f for f in kept.schema.fields}
    schema = ", ".join(f"`{c}` {types[c].dataType.simpleString()}" for c in keep) + ", tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for batch in batches:
            n = [len(ids) for ids in enc.encode(batch.column(batch.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(load(spark, sf_dir, "documents"), "doc_id", "text")


def decode(df: DataFrame, doc_id: str, ids: str, tokenizer: str = TOKENIZER, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text) of every list of ids; null and empty lists give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for batch in batches:
            texts = enc.decode_all([x or [] for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(doc_id).cast("bigint"), F.col(ids)).mapInArrow(run, "doc_id bigint, text string")


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as its ids give it back."""
    return decode(p7_ids(spark, sf_dir), "doc_id", "ids")


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents"), "text", keep=("doc_id",))


QUERIES = {"p7_ids": p7_ids, "p7_round_trip": p7_round_trip, "p7_counts": p7_counts}
SQL = {"p7_round_trip": "select doc_id, coalesce(text, '') as text from documents"}
