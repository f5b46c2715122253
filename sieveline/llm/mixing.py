"""Problem 8: sources mixed to target shares of tokens.

Entropy balancing. Of all ways to use documents at most max_repeats times so that a source gives its tokens, the one
closest (in relative entropy) to using each document once has rates min(max_repeats, exp(lambda * tokens)). The lambda of
each source is the root of its dual's gradient; Newton steps find them all together, each step one distributed
aggregation over (source, tokens) cells. Rates are then rounded to copies from the longest documents to the shortest, so that a source
misses its tokens by about half its shortest document.

Defined cases: documents of sources without a target, of a null source and without tokens are not used; sources without
documents (or with a share of 0 or a null share) give nothing, and the other shares are scaled to what is left; with no
total given, the mix is the largest in which all of them reach their share; with a total, a source that can't reach its
share gives all it may and the report shows it. A null max_repeats is 1. Ties are broken by a hash of doc_id. The table
of targets is small by nature: its rows are the only ones the driver reads.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.llm.tokenize import TOKENIZER, TOKENIZERS, count_tokens
from sieveline.session import cut, hot_split_join, load

TOLERANCE, SPREAD = 1e-9, 1024


def goals(targets: list[tuple[str, float, int]], available: dict[str, int], total: float | None) -> dict[str, tuple[float, int]]:
    """source -> (tokens it has to give, times a document may be used) for the sources that can give any."""
    usable = {s: (share, max(1, cap or 1)) for s, share, cap in targets if s is not None and share and available.get(s)}
    whole = sum(share for share, _ in usable.values())
    if not usable:
        return {}
    most = min(cap * available[s] * whole / share for s, (share, cap) in usable.items())
    size = most if total is None else total
    return {s: (min(share / whole * size, float(cap * available[s])), cap) for s, (share, cap) in usable.items()}


def _rate(cap: str = "cap", lam: str = "lam", scale: str = "scale", tokens: str = "tokens") -> str:
    return f"case when full then cast({cap} as double) else least(cast({cap} as double), exp(least({lam} * {tokens} / {scale}, 50.0D))) end"


def solve(cells: DataFrame, want: dict[str, tuple[float, int]], available: dict[str, int], sizes: dict[str, int]) -> tuple[dict[str, float], dict[str, float], int]:
    """Newton's iterations on the duals of all sources: (lambda, scale of tokens, steps taken).

    A bracket guards each source's step; it is halved wherever Newton's step would leave it, so it ends by itself. A source
    whose bracket holds no other number any more is as near its goal as a rate can bring it.
    """
    spark = cells.sparkSession
    scale = {s: available[s] / sizes[s] for s in want}
    lam = dict.fromkeys(want, 0.0)
    low, high = dict.fromkeys(want, -math.inf), dict.fromkeys(want, math.inf)
    open_ = {s for s, (goal, cap) in want.items() if goal < cap * available[s] * (1 - 1e-12)}
    full = set(want) - open_
    step = 0
    while open_:
        step += 1
        now = spark.createDataFrame([(s, want[s][1], lam[s], scale[s], False) for s in open_], "source string, cap int, lam double, scale double, full boolean")
        at = cells.join(F.broadcast(now), "source").withColumn("rate", F.expr(_rate()))
        weight = F.col("n") * F.col("tokens") * F.col("rate")
        told = at.groupBy("source").agg(F.sum(weight).alias("given"), F.sum(F.when(F.col("rate") < F.col("cap"), weight * F.col("tokens") / F.col("scale")).otherwise(0.0)).alias("slope"))
        for s, given, slope in told.toLocalIterator():
            goal = want[s][0]
            if abs(given - goal) <= max(TOLERANCE * goal, 1e-6):
                open_.discard(s)
                continue
            if given < goal:
                low[s] = lam[s]
            else:
                high[s] = lam[s]
            new = lam[s] + (goal - given) / slope if slope > 0 else math.nan
            if not (low[s] < new < high[s]) or abs(new - lam[s]) > 8:
                if math.isinf(low[s]) or math.isinf(high[s]):
                    new = lam[s] + (4.0 if given < goal else -4.0)
                else:
                    new = (low[s] + high[s]) / 2
            if new in (low[s], high[s], lam[s]):
                open_.discard(s)
                continue
            lam[s] = new
    return lam | dict.fromkeys(full, 0.0), scale, step


PLAN = "source string, tokens bigint, n bigint, rate double, base bigint, more bigint"


def _rounded(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies of each cell, longest documents first; each cell makes up for what the longer ones gave too much or too little."""
    cells = cells.sort_values("tokens", ascending=False)
    base, more, owed = [], [], 0.0
    for t, n, rate in zip(cells["tokens"], cells["n"], cells["rate"], strict=True):
        owed += n * rate * t
        low, high = math.floor(rate), math.ceil(rate)
        copies = min(max(round(owed / t), n * low), n * high)
        owed -= copies * t
        base.append(low)
        more.append(copies - n * low)
    return cells.assign(base=base, more=more)[["source", "tokens", "n", "rate", "base", "more"]]


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, tokenizer: str = TOKENIZER, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, tokens, rate, copies) of every document of the mixed sources. docs: doc_id, source, text."""
    spark = docs.sparkSession
    wanted = targets.select("source", "target_share", "max_repeats").filter("source is not null")
    rows = [(r[0], r[1], r[2]) for r in wanted.toLocalIterator()]
    counted = cut(count_tokens(docs.join(F.broadcast(wanted.select("source").distinct()), "source", "left_semi"), "text", tokenizer, folder), "token-counts")
    cells = cut(counted.filter("tokens > 0").groupBy("source", "tokens").agg(F.count("*").alias("n")), "cells")
    sums = {s: (t, n) for s, t, n in cells.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")), F.sum("n")).toLocalIterator()}
    available, sizes = {s: t for s, (t, _) in sums.items()}, {s: n for s, (_, n) in sums.items()}
    want = goals(rows, available, total)
    lam, scale, _ = solve(cells, want, available, sizes)
    found = spark.createDataFrame([(s, cap, lam[s], scale[s], goal >= cap * available[s] * (1 - 1e-12)) for s, (goal, cap) in want.items()], "source string, cap int, lam double, scale double, full boolean")
    rated = cells.join(F.broadcast(found), "source").withColumn("rate", F.expr(_rate()))
    # A source has at most as many cells as its longest document has tokens, so one task can round them in order.
    plan = cut(rated.groupBy("source").applyInPandas(_rounded, PLAN), "cell-plan")
    held = hot_split_join(counted.filter("tokens > 0"), plan, ["source", "tokens"], "n").withColumn("_h", F.xxhash64("doc_id")).withColumn("_b", F.pmod(F.col("_h"), F.lit(SPREAD)))
    plain = held.filter("more = 0 or more = n").withColumn("extra", (F.col("more") > 0).cast("int"))
    # A cell may hold a third of all documents: its order is that of SPREAD parts, each ranked on its own.
    some = held.filter("more > 0 and more < n")
    part = some.groupBy("source", "tokens", "_b").agg(F.count("*").alias("m"))
    ahead = part.withColumn("ahead", F.coalesce(F.sum("m").over(W.partitionBy("source", "tokens").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("m")
    rank = F.row_number().over(W.partitionBy("source", "tokens", "_b").orderBy("_h", "doc_id"))
    chosen = some.join(ahead, ["source", "tokens", "_b"]).withColumn("extra", (F.col("ahead") + rank <= F.col("more")).cast("int")).drop("ahead")
    return plain.unionByName(chosen).select("doc_id", "source", "tokens", "rate", (F.col("base") + F.col("extra")).cast("int").alias("copies"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: what it has, what it gives, the share it should reach and the one it reaches."""
    given = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens_available"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"))
    # One row per target, so the window over all of them is as small as their table.
    total = F.sum("tokens_used").over(W.partitionBy())
    zero = {c: 0 for c in ("documents", "tokens_available", "copies", "most_copies", "tokens_used")}
    told = targets.select("source", "target_share", "max_repeats").join(F.broadcast(given), "source", "left").fillna(zero).withColumn("actual_share", F.col("tokens_used") / total)
    # A source whose documents would allow more holds back for the one that is used up: the shares of all are kept.
    most = F.col("tokens_available") * F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))
    return told.withColumn("tokens_possible", most).withColumn("used_up", (F.col("tokens_used") > 0) & (F.col("tokens_used") >= most))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = load(spark, sf_dir, "mix_targets")
    return shares(mix(load(spark, sf_dir, "documents"), targets), targets)


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
