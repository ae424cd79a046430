"""Diagnostics as a table: severity thresholds, ordered limits, pivoted summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: severities by rank
SEVERITIES = {"error": 1, "warning": 2, "info": 3, "hint": 4}


def rank(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == k, v) for k, v in SEVERITIES.items()])


def query(rows: DataFrame, least: str | None = None, file: str | None = None, directory: str | None = None, root: str | None = None, limit: int | None = 50, order: tuple = ("file", "line")) -> DataFrame:
    """Diagnostics at least as severe, of a file (by suffix), a directory (by substring) and a root, worst first."""
    out = rows
    if least:
        out = out.where(F.col("severity") <= SEVERITIES[least])
    if file:
        out = out.where((F.col("file") == file) | F.col("file").endswith(file))
    if directory:
        out = out.where(F.col("file").contains(directory))
    if root:
        out = out.where(F.col("root") == root)
    out = out.orderBy("severity", *order)
    return out.limit(limit) if limit else out


def _counts() -> list[Column]:
    return [F.count_if(F.col("severity") == v).alias(k + "s") for k, v in SEVERITIES.items()]


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(*_counts(), F.countDistinct("file").alias("files"), F.count("*").alias("total"))


def summary_by(rows: DataFrame, group: str = "root", unknown: str = "(unknown)") -> DataFrame:
    return rows.groupBy(F.coalesce(group, F.lit(unknown)).alias(group)).agg(*_counts(), F.countDistinct("file").alias("files"), F.count("*").alias("total"))


def covering(rows: DataFrame, file: str, line: int) -> DataFrame:
    """Diagnostics whose range covers a line."""
    return rows.where((F.col("file") == file) & (F.col("line") <= line) & (F.coalesce("end_line", "line") >= line))


def replace_by_key(state: DataFrame, feed: DataFrame, key: str = "uri", version: str = "version") -> DataFrame:
    """The last list of each key replaces what was there; an empty last list (message null) deletes the key."""
    last = feed.groupBy(key).agg(F.max(version).alias(version))
    newest = feed.join(last, [key, version])
    kept = state.join(last.select(key), key, "left_anti")
    return kept.unionByName(newest.where("message is not null").select(*state.columns))


def health(servers: DataFrame) -> DataFrame:
    """Running servers, available languages and restarts."""
    return servers.agg(F.count_if(F.col("state") == "running").alias("running"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"), F.sum(F.greatest(F.col("boots") - 1, F.lit(0))).alias("restarts"))


def unavailable_reason(error: Column, boots: Column, most: int = 3) -> Column:
    """Why a server is not there: ordered substrings of its last error, then its boots."""
    low = F.lower(error)
    return (
        F.when(low.contains("enoent") | low.contains("not found"), "not installed").when(low.contains("eacces") | low.contains("permission"), "not permitted")
        .when(low.contains("timeout") | low.contains("timed out"), "timed out").when(low.contains("memory"), "out of memory")
        .when(boots >= most, "crashed repeatedly").when(error.isNotNull(), "failed to start").otherwise("unknown")
    )
