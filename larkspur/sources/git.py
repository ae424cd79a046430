"""Output of version control as tables; the text is the input, no process is run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RECORD, FIELD = "<||>", "<|>"


def status_label(sign) -> F.Column:
    """A porcelain status sign in words."""
    pairs = {"M": "modified", "A": "added", "D": "deleted", "R": "renamed", "C": "copied", "U": "conflict", "?": "untracked", "!": "ignored", "T": "typechange"}
    return F.coalesce(*[F.when(sign == k, v) for k, v in pairs.items()], F.lit("unchanged"))


def status(raw: DataFrame, key: str = "id") -> DataFrame:
    """(key, path, old_path, index, worktree) of NUL-separated porcelain text; a rename takes the next field as its old path."""
    fields = raw.select(key, F.posexplode(F.filter(F.split("raw", "\u0000"), lambda x: F.length(x) > 0)).alias("_p", "_f"))
    w = Window.partitionBy(key).orderBy("_p")
    renames = F.col("_f").rlike(r"^[RC][ MD] |^ [RC] ")
    marked = fields.withColumn("_before", F.lag("_f").over(w)).withColumn("_next", F.lead("_f").over(w)).withColumn("_is_old", F.coalesce(F.lag(renames).over(w), F.lit(False)) & ~F.col("_f").rlike(r"^[ MADRCU?!T]{2} "))
    rows = marked.where("not _is_old and length(_f) > 3")
    return rows.select(key, F.substring("_f", 4, 100_000).alias("path"), F.when(renames, F.col("_next")).alias("old_path"), status_label(F.substring("_f", 1, 1)).alias("index"), status_label(F.substring("_f", 2, 1)).alias("worktree"))


def log(raw: DataFrame, key: str = "id") -> DataFrame:
    """(key, hash, author, date, message, files) of records separated by ``RECORD`` with fields separated by ``FIELD``."""
    records = raw.select(key, F.explode(F.split("raw", r"<\|\|>")).alias("_r")).where(F.trim("_r") != "")
    parts = F.split(F.trim("_r"), r"<\|>")
    tail = F.split(F.element_at(parts, -1), "\n")
    files = F.filter(F.slice(tail, F.lit(2), F.greatest(F.size(tail) - 1, F.lit(0))), lambda x: F.trim(x) != "")
    return records.where(F.size(parts) >= 4).select(key, parts[0].alias("hash"), parts[1].alias("author"), F.try_to_timestamp(parts[2]).alias("date"), F.trim(tail[0]).alias("message"), files.alias("files"))


def branches(raw: DataFrame, key: str = "id") -> DataFrame:
    """(key, name, current, upstream) of tab-separated branch lines; a detached head is named so."""
    rows = raw.select(key, F.explode(F.split("raw", "\n")).alias("_l")).where(F.trim("_l") != "")
    parts = F.split("_l", "\t")
    name = F.trim(F.regexp_replace(parts[0], r"^\*?\s*", ""))
    return rows.select(key, F.when(name.contains("HEAD detached"), "HEAD (detached)").otherwise(name).alias("name"), F.col("_l").startswith("*").alias("current"), F.when(F.size(parts) > 1, F.nullif(F.trim(F.try_element_at(parts, F.lit(2))), F.lit(""))).alias("upstream"))


def diff_lines(raw: DataFrame, key: str = "id") -> DataFrame:
    """(key, line_no, path, hunk, sign, line) of unified diffs; counts of a hunk only inside of it."""
    lines = raw.select(key, F.posexplode(F.split("raw", "\n")).alias("line_no", "line"))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header = F.col("line").startswith("diff --git ")
    marked = lines.withColumn("path", F.last(F.when(header, F.regexp_extract("line", r" b/(.*)$", 1)), ignorenulls=True).over(w)).withColumn("_file", F.sum(header.cast("int")).over(w))
    inside = Window.partitionBy(key, "_file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    hunk = F.last(F.when(F.col("line").startswith("@@"), F.col("line")), ignorenulls=True).over(inside)
    sign = F.when(F.col("line").startswith("@@"), "@").when(F.col("line").startswith("+") & ~F.col("line").startswith("+++"), "+").when(F.col("line").startswith("-") & ~F.col("line").startswith("---"), "-").otherwise(" ")
    return marked.withColumn("hunk", hunk).where("hunk is not null").select(key, "line_no", "path", "hunk", sign.alias("sign"), "line")


def diff_files(raw: DataFrame, key: str = "id") -> DataFrame:
    """(key, path, insertions, deletions, hunks)."""
    return diff_lines(raw, key).groupBy(key, "path").agg(F.count_if(F.col("sign") == "+").alias("insertions"), F.count_if(F.col("sign") == "-").alias("deletions"), F.count_if(F.col("sign") == "@").alias("hunks"))


def diff_totals(raw: DataFrame, key: str = "id") -> DataFrame:
    return diff_files(raw, key).groupBy(key).agg(F.count("*").alias("files"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))


def diffstat(lines: DataFrame) -> DataFrame:
    """The lines of a diff summary, `` path | 12 ++--``, with the path, its changed lines and the shown signs."""
    shape = r"^ (\S[^|]*\S|\S) +\| +(\d+) (\+*)(-*)$"
    hit = lines.where(F.col("line").rlike(shape))
    part = lambda n: F.regexp_extract("line", shape, n)
    return hit.withColumns({"path": part(1), "changed": part(2).cast("int"), "plus": F.length(part(3)), "minus": F.length(part(4))})
