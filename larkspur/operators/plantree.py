"""Plan trees as flat tables: rollups, promotion and updates without recursion.

A task row has plan_id, path ('2.1.3'), parent ('2.1', '' at the top), status, checkpoint. What lies above a task
is in its path, so closures are exploded ancestors joined by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("completed", "cancelled")
ENDED = ("completed", "cancelled", "failed")


def above(path: Column) -> Column:
    """The task's own path and those above it."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def position(path: Column) -> Column:
    """Sort key of depth-first order."""
    return F.transform(F.split(path, r"\."), lambda x: x.cast("int"))


def progress(tasks: DataFrame, group: str = "plan_id") -> DataFrame:
    """Tasks and completed tasks of each plan, at all depths."""
    return tasks.groupBy(group).agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "completed").alias("completed")).withColumn("progress", F.round(F.col("completed") / F.col("tasks"), 4))


def settled(tasks: DataFrame, terminal: tuple = TERMINAL) -> DataFrame:
    """(plan_id, path, settled) of each task with children: whether all of them have ended."""
    kids = tasks.where("parent <> ''")
    return kids.groupBy("plan_id", F.col("parent").alias("path")).agg(F.bool_and(F.coalesce(F.col("status").isin(*terminal), F.lit(False))).alias("settled"))


def pending_checkpoints(tasks: DataFrame, saved: DataFrame) -> DataFrame:
    """Checkpoint tasks whose children have all ended and that have no checkpoint yet."""
    due = tasks.where("checkpoint").join(settled(tasks).where("settled").drop("settled"), ["plan_id", "path"])
    return due.join(saved.select("plan_id", "path").distinct(), ["plan_id", "path"], "left_anti")


def promote(tasks: DataFrame) -> DataFrame:
    """Statuses from the leaves up: a task whose children have all ended is failed if one failed, else completed.

    Without a loop over levels: an open task ends when no open leaf is reached from it through open tasks, and
    fails when a failed task is. So each ended task and each leaf tells all tasks above it up to its nearest ended
    one, and one aggregation a task decides.
    """
    depth = lambda c: F.size(F.split(c, r"\."))
    ended = F.coalesce(F.col("status").isin(*ENDED), F.lit(False))
    state = tasks.select("plan_id", F.col("path").alias("_a"), ended.alias("_ended"))
    closure = tasks.select("plan_id", "path", "status", F.explode(above(F.col("path"))).alias("_a")).join(state, ["plan_id", "_a"])
    barrier = F.coalesce(F.max(F.when(F.col("_ended") & (F.col("_a") != F.col("path")), depth("_a"))), F.lit(0))
    known = closure.groupBy("plan_id", "path").agg(barrier.alias("_d"), F.max("status").alias("status"))
    parents = tasks.where("parent <> ''").select("plan_id", F.col("parent").alias("path")).distinct()
    leaves = known.where(~ended).join(parents, ["plan_id", "path"], "left_anti")
    told = known.where(ended).unionByName(leaves).select("plan_id", (~ended).alias("_open"), F.coalesce(F.col("status") == "failed", F.lit(False)).alias("_bad"), F.explode(F.filter(above(F.col("path")), lambda a: (depth(a) > F.col("_d")) & (a != F.col("path")))).alias("path"))
    decided = told.groupBy("plan_id", "path").agg(F.bool_or("_open").alias("_open"), F.bool_or("_bad").alias("_bad"))
    out = tasks.join(decided, ["plan_id", "path"], "left")
    settles = ~ended & (F.col("_open") == F.lit(False))
    return out.withColumn("status", F.when(settles, F.when(F.col("_bad"), "failed").otherwise("completed")).otherwise(F.col("status"))).drop("_open", "_bad")


def completed_path(tasks: DataFrame) -> DataFrame:
    """Tasks that are completed together with all tasks above them."""
    up = tasks.select("plan_id", "path", F.explode(above(F.col("path"))).alias("_a"))
    state = tasks.select("plan_id", F.col("path").alias("_a"), (F.col("status") == "completed").alias("_ok"))
    good = up.join(state, ["plan_id", "_a"]).groupBy("plan_id", "path").agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("_good")).where("_good").drop("_good")
    return tasks.join(good, ["plan_id", "path"], "left_semi")


def context_rollup(entries: DataFrame, tasks: DataFrame) -> DataFrame:
    """(plan_id, entity, text, first) of context entries of completed paths; files once, at their first place."""
    inside = entries.join(completed_path(tasks).select("plan_id", F.col("path").alias("parent")), ["plan_id", "parent"], "left_semi")
    files = inside.where("entity = 'file'").groupBy("plan_id", "entity", "text").agg(F.min("path").alias("path"))
    return inside.where("entity <> 'file'").select("plan_id", "entity", "text", "path").unionByName(files.select("plan_id", "entity", "text", "path"))


def current_task(tasks: DataFrame) -> DataFrame:
    """Each plan's first task in progress in depth-first order, else its first pending one."""
    rank = F.when(F.col("status") == "in_progress", 0).when(F.col("status") == "pending", 1)
    return tasks.where(rank.isNotNull()).groupBy("plan_id").agg(F.min_by("path", F.struct(rank, position(F.col("path")))).alias("path"))


def cancel(tasks: DataFrame, chosen: DataFrame) -> DataFrame:
    """Cancels the chosen (plan_id, path) with all below, but for what is completed."""
    marked = chosen.select("plan_id", F.col("path").alias("_a")).distinct()
    below = tasks.select("plan_id", "path", F.explode(above(F.col("path"))).alias("_a")).join(marked, ["plan_id", "_a"], "left_semi").select("plan_id", "path").distinct().withColumn("_hit", F.lit(True))
    out = tasks.join(below, ["plan_id", "path"], "left")
    return out.withColumn("status", F.when(F.col("_hit") & (F.col("status") != "completed"), "cancelled").otherwise(F.col("status"))).drop("_hit")


def apply_updates(tasks: DataFrame, updates: DataFrame, key: tuple = ("plan_id", "path")) -> DataFrame:
    """Status updates (key, seq, status): the last of each task wins; unknown tasks are ignored."""
    last = updates.groupBy(*key).agg(F.max_by("status", "seq").alias("_new"))
    return tasks.join(last, list(key), "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def next_ids(tasks: DataFrame, parents: DataFrame) -> DataFrame:
    """The id that a new child of each (plan_id, path) gets: parent.n."""
    counted = tasks.groupBy("plan_id", F.col("parent").alias("path")).agg(F.max(F.element_at(F.split("path", r"\."), -1).cast("int")).alias("_n"))
    n = (F.coalesce("_n", F.lit(0)) + 1).cast("string")
    return parents.join(counted, ["plan_id", "path"], "left").select("plan_id", "path", F.when(F.col("path") == "", n).otherwise(F.concat_ws(".", "path", n)).alias("child"))


def merge_context(a: Column, b: Column) -> Column:
    """Findings and decisions of both in order, files once."""
    return F.struct(F.concat(a["findings"], b["findings"]).alias("findings"), F.concat(a["decisions"], b["decisions"]).alias("decisions"), F.array_union(a["files"], b["files"]).alias("files"))
