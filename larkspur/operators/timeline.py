"""Order-dependent time logic on hot keys: thinning, debounce, siblings. Time is in microseconds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def micros(column) -> F.Column:
    return F.unix_micros(column.cast("timestamp"))


def _jump(ts: np.ndarray, gap: int) -> np.ndarray:
    """Index of the first event at least ``gap`` after each event (events in order)."""
    return np.maximum(np.searchsorted(ts, ts + gap, side="left"), np.arange(len(ts)) + 1)


def thin(events: DataFrame, key: str, at: str, id_: str, gap: int, block: int | None = None) -> DataFrame:
    """First-wins thinning: an event is kept when the last kept one of its key is at least ``gap`` before it.

    Sequential by nature, but cut in time blocks: (1) each block tells, for every event that might be its first
    kept one, the time of its last kept one, as few steps, since chains soon meet; (2) these summaries, a row a
    block, are folded along each key; (3) each block is thinned knowing what came before. No key is held whole.
    Null keys form one key; null times are dropped; ties go to the smaller id; a suppressed event doesn't extend.
    """
    block = block or gap * 256
    rows = events.where(F.col(at).isNotNull()).withColumn("_b", F.floor(F.col(at) / block)).withColumn("_k", F.coalesce(F.col(key).cast("string"), F.lit("\0")))

    def summarise(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ts = np.sort(pdf[at].to_numpy(np.int64))
        nxt = _jump(ts, gap)
        last = np.empty(len(ts), np.int64)
        for i in range(len(ts) - 1, -1, -1):
            last[i] = ts[i] if nxt[i] >= len(ts) else last[nxt[i]]
        near = np.searchsorted(ts, ts[0] + gap, side="right")
        starts = ts[: near + 1]
        change = np.flatnonzero(np.r_[True, last[1 : len(starts)] != last[: len(starts) - 1]])
        # an event after the inherited one: outcome by the first start at or after it
        return pd.DataFrame({"_k": [keys[0]], "_b": [keys[1]], "starts": [[int(starts[c]) for c in np.r_[change[1:] - 1, len(starts) - 1]]], "lasts": [[int(last[c]) for c in change]], "all": [int(ts[-1])]})

    def fold(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b")
        kept, out = None, []
        for b, starts, lasts, end in zip(pdf["_b"], pdf["starts"], pdf["lasts"], pdf["all"]):
            out.append((keys[0], b, kept))
            need = -(1 << 62) if kept is None else kept + gap
            if need <= end:
                at_ = int(np.searchsorted(np.asarray(starts), need, side="left"))
                kept = int(lasts[at_]) if at_ < len(starts) else kept
        return pd.DataFrame(out, columns=["_k", "_b", "_last"]).astype({"_last": "Int64"})

    columns = events.columns

    def emit(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, id_], kind="stable")
        ts = pdf[at].to_numpy(np.int64)
        before = pdf["_last"].iloc[0]
        i = 0 if pd.isna(before) else int(np.searchsorted(ts, int(before) + gap, side="left"))
        nxt, kept = _jump(ts, gap), []
        while i < len(ts):
            kept.append(i)
            i = int(nxt[i])
        return pdf.iloc[kept][columns]

    slim = rows.select("_k", "_b", at)
    summary = slim.groupBy("_k", "_b").applyInPandas(summarise, f"_k string, _b bigint, starts array<bigint>, lasts array<bigint>, `all` bigint")
    inherited = summary.groupBy("_k").applyInPandas(fold, "_k string, _b bigint, _last bigint")
    schema = events.schema
    return rows.join(inherited, ["_k", "_b"]).groupBy("_k", "_b").applyInPandas(emit, schema)


def previous_by_blocks(rows: DataFrame, key: str, at: str, ties: str, block: int) -> DataFrame:
    """Adds ``_prev``, the time of the event before in its key; blocks of time keep a hot key apart."""
    rows = rows.withColumn("_b", F.floor(F.col(at) / block))
    inside = Window.partitionBy(key, "_b").orderBy(at, ties)
    ends = rows.groupBy(key, "_b").agg(F.max(at).alias("_end"))
    ends = ends.withColumn("_carry", F.lag("_end").over(Window.partitionBy(key).orderBy("_b"))).select(key, "_b", "_carry")
    return rows.withColumn("_lag", F.lag(at).over(inside)).join(ends, [key, "_b"]).withColumn("_prev", F.coalesce("_lag", "_carry")).drop("_lag", "_carry", "_b")


def debounce(events: DataFrame, key: str, at: str, id_: str, quiet: int, block: int | None = None) -> DataFrame:
    """Trailing debounce: the last event of each run of events closer than ``quiet``; a newer event resets the wait.

    An event is the last of its run when the next one of its key comes ``quiet`` later or more, or never.
    """
    turned = events.withColumn("_neg", -F.col(at)).withColumn("_negid", -F.col(id_))
    after = previous_by_blocks(turned, key, "_neg", "_negid", block or quiet * 256)
    return after.where(F.col("_prev").isNull() | (-F.col("_prev") - F.col(at) >= quiet)).drop("_neg", "_negid", "_prev")


def siblings(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Previous and next name in a file's order."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("previous", F.lag(name).over(w)).withColumn("following", F.lead(name).over(w))


def nearest(rows: DataFrame, key: list[str], distance: F.Column, ties: list, within: int | None = None) -> DataFrame:
    """The row at the smallest absolute distance; of two as near, the one before."""
    if within is not None:
        rows = rows.where(F.abs(distance) <= within)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.abs(distance), distance, *ties))).where("_n = 1").drop("_n")
