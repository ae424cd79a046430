"""Mixing sources to target weights by subset-sum budget fitting.

Token counts are exact (a public tokenizer, whose path is a parameter). The total is the largest at which every
listed source that has documents can reach its share within its repeats, or a given one. Each source's budget is
filled by whole passes over its documents, then by a share of each exact token length, and what remains by a
bounded-knapsack dynamic program over the counts of exact lengths (bit sets); the documents of each length are
then taken in a seeded order. Only the histogram (source, length, count), bounded by the longest document, comes
to the driver. Ranks within a length are found in hash buckets with counted offsets, so that a length or source
that holds a third of all rows is never sorted in one task.

Defined results: sources compare without case and outer blanks; null source, null or empty text: not drawn; a
listed source without documents is reported with 0 tokens, an unlisted source of documents with target null; a
repeated doc_id counts once; a null, zero or negative share or repeat draws nothing; ties follow the seeded hash.
"""

from __future__ import annotations

import base64
import os
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import cut, spread

VOCABULARY = os.environ.get("LARKSPUR_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: splits text before byte-pair merges, as published with byte-level BPE vocabularies
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 256
GAP = 60_000
_ENCODERS: dict = {}


def encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def source_key(column) -> F.Column:
    return F.lower(F.trim(F.regexp_replace(column, r"^\s+|\s+$", "")))


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens): each document once; a narrow pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    picked = documents.select(F.col("doc_id").cast("long"), source_key(F.col("source")).alias("source"), F.col("text").cast("string"))
    counted = spread(picked).mapInArrow(run, "doc_id bigint, source string, tokens bigint")
    return counted.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens"))


def fit(histogram: dict[int, int], budget: int, repeats: int, seed: int) -> tuple[int, dict[int, int]]:
    """(whole passes, {length: documents used once more}) whose tokens come as near to the budget as can be, never above."""
    total = sum(n * c for n, c in histogram.items())
    if budget <= 0 or repeats <= 0 or total == 0:
        return 0, {}
    budget = min(budget, total * repeats)
    passes = min(repeats, budget // total)
    rest = budget - passes * total
    if rest == 0 or passes == repeats:
        return passes, {}
    share = rest / total
    taken = {n: min(c, int(share * c)) for n, c in histogram.items()}
    gap = rest - sum(n * c for n, c in taken.items())
    order = sorted(histogram)
    random.Random(seed).shuffle(order)
    for n in order:  # one more of a length while the gap is wide
        if gap <= GAP:
            break
        if taken[n] < histogram[n] and n <= gap:
            more = min(histogram[n] - taken[n], max(1, (gap - GAP // 2) // n))
            taken[n] += more
            gap -= more * n
    # bounded knapsack: reach[k] has a bit for each sum of the first k items; an item is 2^j documents of a length
    items = []
    for n in order:
        left, j = min(histogram[n] - taken[n], gap // n), 1
        while left > 0:
            j = min(j, left)
            items.append((n, j))
            left -= j
            j *= 2
    mask, reach = (1 << (gap + 1)) - 1, [1]
    for n, j in items:
        got = (reach[-1] | reach[-1] << (n * j)) & mask
        reach.append(got)
        if got >> gap & 1:
            break
    at = reach[-1].bit_length() - 1
    for k in range(len(reach) - 1, 0, -1):
        if not reach[k - 1] >> at & 1:
            n, j = items[k - 1]
            taken[n] += j
            at -= n * j
    return passes, {n: c for n, c in taken.items() if c}


def plan(counted: DataFrame, targets: DataFrame, total: int | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """(plan: source, tokens, passes, more; report) from the histogram of exact lengths."""
    spark = counted.sparkSession
    wanted: dict[str, tuple[float, int]] = {}
    for r in targets.select(source_key(F.col("source")).alias("s"), F.col("target_share").cast("double").alias("t"), F.col("max_repeats").cast("int").alias("m")).distinct().orderBy("s", "t", "m").collect():
        if r.s is not None:
            wanted[r.s] = (max(0.0, r.t or 0.0), max(0, r.m or 0))
    lengths: dict[str, dict[int, int]] = {}
    for r in counted.where("source is not null and tokens > 0").groupBy("source", "tokens").count().toLocalIterator():
        lengths.setdefault(r["source"], {})[r["tokens"]] = r["count"]
    room = {s: sum(n * c for n, c in h.items()) * wanted[s][1] for s, h in lengths.items() if s in wanted}
    limits = [room[s] / wanted[s][0] for s in room if wanted[s][0] > 0 and room[s] > 0]
    whole = int(min(limits)) if total is None and limits else (total or 0)
    rows, drawn = [], {}
    for s in sorted(room):
        passes, more = fit(lengths[s], int(wanted[s][0] * whole), wanted[s][1], seed)
        drawn[s] = (passes, sum(more.values()), passes * sum(n * c for n, c in lengths[s].items()) + sum(n * c for n, c in more.items()))
        rows += [(s, n, passes, more.get(n, 0)) for n in lengths[s] if passes or more.get(n)]
    reached = sum(x[2] for x in drawn.values())
    report = [
        (s, wanted[s][0] if s in wanted else None, wanted[s][1] if s in wanted else None, sum(h.values()), sum(n * c for n, c in h.items()), drawn.get(s, (0, 0, 0))[2], drawn.get(s, (0, 0, 0))[2] / reached if reached else 0.0)
        for s, h in sorted(lengths.items())
    ] + [(s, t, m, 0, 0, 0, 0.0) for s, (t, m) in sorted(wanted.items()) if s not in lengths]
    planned = spark.createDataFrame(rows, "source string, tokens bigint, passes int, more bigint")
    reported = spark.createDataFrame(report, "source string, target_share double, max_repeats int, documents bigint, source_tokens bigint, drawn_tokens bigint, actual_share double")
    return planned, reported


def mixed(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, repeats) of each document drawn."""
    counted = cut(token_counts(documents, vocabulary))
    planned, _ = plan(counted, targets, total, seed)
    rows = counted.where("source is not null and tokens > 0").join(planned, ["source", "tokens"])
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    before = Window.partitionBy("source", "tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("source", "tokens", "bucket").agg(F.count("*").alias("n")).select("source", "tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "tokens", "bucket").orderBy("h", "doc_id")
    ranked = rows.withColumn("k", F.row_number().over(within)).join(offsets, ["source", "tokens", "bucket"])
    repeats = F.col("passes") + F.when(F.col("offset") + F.col("k") <= F.col("more"), 1).otherwise(0)
    return ranked.select("doc_id", "source", "tokens", repeats.cast("int").alias("repeats")).where("repeats > 0")


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per source: target share, tokens there, tokens drawn and the share really reached."""
    _, report = plan(cut(token_counts(documents, vocabulary)), targets, total, seed)
    return report.withColumn("actual_share", F.round("actual_share", 8))
