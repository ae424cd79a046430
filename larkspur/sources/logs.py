"""Logs and settings kept as text: Markdown error logs, call logs, dotenv files, command rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def error_entries(logs: DataFrame, key: str = "id") -> DataFrame:
    """(key, n, ts, tool, error, status, resolution, source) of the ``###`` blocks that have time, tool and error.

    The tool stands in a field of its own or in backticks, the first of the block; the source is auto or agent.
    """
    blocks = logs.select(key, F.posexplode(F.split("content", r"(?m)^### ")).alias("n", "_b")).where("n > 0")
    field = lambda name: F.nullif(F.trim(F.regexp_extract("_b", rf"(?im)^[-*]?\s*\**{name}\**:\**\s*(.+)$", 1)), F.lit(""))
    ts = F.nullif(F.regexp_extract("_b", r"(\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d)?)", 1), F.lit(""))
    ticked = F.nullif(F.regexp_extract("_b", r"`([^`]+)`", 1), F.lit(""))
    rows = blocks.select(key, "n", F.try_to_timestamp(F.replace(ts, F.lit("T"), F.lit(" "))).alias("ts"), F.coalesce(field("tool"), ticked).alias("tool"), field("error").alias("error"), F.coalesce(F.nullif(F.replace(field("status"), F.lit("`"), F.lit("")), F.lit("")), F.lit("unresolved")).alias("status"), field("resolution").alias("resolution"), F.when(F.contains(field("source"), F.lit("Auto")), "auto").otherwise("agent").alias("source"))
    return rows.where("ts is not null and tool is not null and error is not null")


def status_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("status").agg(F.count("*").alias("entries"))


def unresolved_head(entries: DataFrame, n: int = 20, most: int = 120) -> DataFrame:
    return entries.where("status = 'unresolved'").orderBy("ts", "n").limit(n).withColumn("error", F.substring("error", 1, most))


def resolve_nth(entries: DataFrame, n: int, resolution: str, status: str = "resolved") -> DataFrame:
    """The n-th unresolved entry by time gets a resolution. One small log is ordered as a whole: its size is a person's log."""
    w = Window.partitionBy("status").orderBy("ts", "n")
    ranked = entries.withColumn("_k", F.when(F.col("status") == "unresolved", F.row_number().over(w)))
    hit = F.col("_k") == n
    return ranked.withColumn("resolution", F.when(hit, resolution).otherwise(F.col("resolution"))).withColumn("status", F.when(hit, status).otherwise(F.col("status"))).drop("_k")


def call_log(calls: DataFrame, most: int = 200) -> DataFrame:
    """Call rows with a day to partition by and long fields as their size."""
    from ..functions.text import summarise_field

    return calls.withColumn("date", F.date_format("ts", "yyyy-MM-dd")).withColumn("input", summarise_field(F.col("input"), most)).withColumn("output", summarise_field(F.col("output"), most))


def dotenv(texts: DataFrame, key: str = "id") -> DataFrame:
    """(key, name, comment): comment lines gather until the variable or a blank line."""
    lines = texts.select(key, F.posexplode(F.split("content", r"\r?\n")).alias("n", "l"))
    w = Window.partitionBy(key).orderBy("n")
    ends = F.when((F.trim("l") == "") | ~F.trim("l").startswith("#"), 1).otherwise(0)
    island = lines.withColumn("_g", F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    name = F.regexp_extract("l", r"^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=", 1)
    note = F.regexp_replace(F.trim("l"), r"^#+\s*", "")
    grouped = island.groupBy(key, "_g").agg(F.max(F.nullif(name, F.lit(""))).alias("name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.trim("l").startswith("#"), F.struct("n", note.alias("t"))))), lambda x: x["t"]), "; ").alias("comment"))
    return grouped.where("name is not null").select(key, "name", "comment")


#: ordered rules: (pattern, reason, blocked)
COMMAND_RULES = [
    (r"\brm\s+(?:-[a-zA-Z]+\s+)*/(?:[\s*]|$)", "deletes the root directory", True),
    (r"\brm\s+(?:-[a-zA-Z]+\s+)*~(?:[/\s*]|$)", "deletes the home directory", True),
    (r"\brm\s+(?:-\w*[rf]\w*\s+)+(?:/|~|\$HOME)(?:\s|\*|$)", "removes a root or home directory", True),
    (r"\bmkfs(?:\.\w+)?\b", "formats a file system", True),
    (r"\bdd\b.*\bof=/dev/", "writes to a device", True),
    (r":\(\)\s*\{.*\};\s*:", "forks without end", True),
    (r"\b(?:curl|wget)\b[^|]*\|\s*(?:sudo\s+)?(?:ba|z)?sh\b", "runs a download", True),
    (r"\bgit\s+push\s+.*(?:--force|-f)\b", "rewrites published history", False),
    (r"\bgit\s+reset\s+--hard\b", "drops local changes", False),
    (r"\bsudo\b", "needs higher rights", False),
    (r"\bchmod\s+(?:-R\s+)?777\b", "opens permissions to all", False),
]
BARE_SESSIONS = ("python", "python3", "node", "irb", "psql", "mysql", "sqlite3", "bash", "sh", "zsh")


def judge_command(command: Column) -> Column:
    """struct(blocked, reason): the first blocking rule, else the first warning; a bare interactive session is blocked."""
    verdict = lambda reason, blocked: F.struct(F.lit(blocked).alias("blocked"), F.lit(reason).alias("reason"))
    ordered = [r for r in COMMAND_RULES if r[2]] + [r for r in COMMAND_RULES if not r[2]]
    out = F.struct(F.lit(False).alias("blocked"), F.lit(None).cast("string").alias("reason"))
    for pattern, reason, blocked in reversed([r for r in ordered if not r[2]]):
        out = F.when(command.rlike(pattern), verdict(reason, blocked)).otherwise(out)
    out = F.when(F.trim(command).isin(*BARE_SESSIONS), verdict("waits for input", True)).otherwise(out)
    for pattern, reason, blocked in reversed([r for r in ordered if r[2]]):
        out = F.when(command.rlike(pattern), verdict(reason, blocked)).otherwise(out)
    return out


def leveled(lines: DataFrame) -> DataFrame:
    """Log lines that begin with an ISO time and a level: at, level, message."""
    shape = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ) (DEBUG|INFO|WARN|ERROR) (.*)$"
    part = lambda n: F.regexp_extract("line", shape, n)
    return lines.where(F.col("line").rlike(shape)).withColumns({"at": part(1), "level": part(2), "message": part(3)})
