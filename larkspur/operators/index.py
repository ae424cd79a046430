"""The symbol table and its upkeep: upsert, replacement by file, lookups, snapshot differences, summaries.

A symbol row has name, kind, file, start_line, end_line, signature, docs, code. Its key is (name, file, start_line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import short_name, top_directory

KEY = ["name", "file", "start_line"]


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str | None = None) -> DataFrame:
    """Rows of both, the newest of a key: by ``version``, or the new frame's over the old one's."""
    if version:
        return latest(old.unionByName(new), key, [F.col(version).desc()])
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.dropDuplicates(key))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def latest_by(rows: DataFrame, key: list[str], value: list[str], order: list[str]) -> DataFrame:
    """The same by aggregation (combined before the shuffle, so hot keys cost a row a task)."""
    best = F.max_by(F.struct(*value), F.struct(*order)).alias("_best")
    return rows.groupBy(*key).agg(best).select(*key, "_best.*")


def replace_files(old: DataFrame, new: DataFrame, files: DataFrame, on: str = "file") -> DataFrame:
    """All rows of ``files`` removed from the old table, then the new ones added."""
    return remove_files(old, files, on).unionByName(new)


def remove_files(old: DataFrame, files: DataFrame, on: str = "file") -> DataFrame:
    return old.join(files.select(on).distinct(), on, "left_anti")


def missing_ids(wanted: DataFrame, present: DataFrame, on: str = "id") -> DataFrame:
    """What has still to be embedded: an anti join on the id."""
    return wanted.join(present.select(on).distinct(), on, "left_anti")


def symbol_id(file: Column, name: Column, line: Column) -> Column:
    return F.concat_ws("::", file, name, line.cast("string"))


def serialise(kind: Column, name: Column, signature: Column, docs: Column, file: Column) -> Column:
    """A symbol as text to embed; the signature only where it adds something."""
    adds = (signature.contains("(") | signature.contains(":")) & (signature != name)
    return F.concat_ws(" ", kind, name, F.when(adds, signature), F.when(F.length(docs) > 0, F.concat(F.lit("— "), docs)), F.concat(F.lit("| "), file))


def lookup_exact(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("name") == name)


def lookup_partial(symbols: DataFrame, text: str) -> DataFrame:
    return symbols.where(F.contains(F.lower("name"), F.lit(text.lower())))


def lookup_file(symbols: DataFrame, file: str) -> DataFrame:
    return symbols.where(F.col("file") == file).orderBy("start_line", "name")


def resolve(symbols: DataFrame, query: str) -> DataFrame:
    """The cascade of ``name``, ``file:name``, ``Scope.name`` and ``file:line``: rows of the best tier that has any."""
    head, sep, tail = query.rpartition(":")
    tiers: list[Column] = []
    if sep and tail.isdigit():
        inside = ((F.col("file") == head) | F.col("file").endswith("/" + head)) & (F.col("start_line") <= int(tail)) & (F.col("end_line") >= int(tail))
        best = Window.orderBy(F.col("end_line") - F.col("start_line"), "start_line", "name")
        return symbols.where(inside).withColumn("tier", F.lit(1)).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    if sep:
        in_file = (F.col("file") == head) | F.col("file").endswith("/" + head)
        tiers = [in_file & (F.col("name") == tail), in_file & F.col("name").endswith("." + tail), in_file & F.contains(F.lower("name"), F.lit(tail.lower()))]
    else:
        tiers = [F.col("name") == query, F.col("name").endswith("." + query), F.contains(F.lower("name"), F.lit(query.lower()))]
    tier = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(tiers, 1)])
    hits = symbols.withColumn("tier", tier).where("tier is not null")
    least = hits.agg(F.min("tier").alias("_least"))
    return hits.join(F.broadcast(least), F.col("tier") == F.col("_least")).drop("_least")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """(key, change): added, updated, removed or unchanged, by one full outer join."""
    o, n = old.select(key, F.col(version).alias("_o"), F.lit(True).alias("_in_o")), new.select(key, F.col(version).alias("_n"), F.lit(True).alias("_in_n"))
    change = F.when(F.col("_in_o").isNull(), "added").when(F.col("_in_n").isNull(), "removed").when(F.col("_o").eqNullSafe(F.col("_n")), "unchanged").otherwise("updated")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def maintain(table: DataFrame, diff: DataFrame, extracted: DataFrame, key: str = "file") -> DataFrame:
    """Incremental upkeep: rows of removed and updated files leave, freshly extracted ones come."""
    gone = diff.where(F.col("change").isin("removed", "updated"))
    fresh = extracted.join(diff.where(F.col("change").isin("added", "updated")).select(key), key, "left_semi")
    return replace_files(table, fresh, gone, key)


def summary(files: DataFrame, symbols: DataFrame, ranks: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """One row a file over the union of all keys: lines (or the last symbol's end), symbol count, rank, imports, exports."""
    spine = files.select("file").union(symbols.select("file")).union(ranks.select("file")).distinct()
    counted = symbols.groupBy("file").agg(F.count("*").alias("symbols"), F.max("end_line").alias("_end"))
    im = imports.groupBy("file").agg(F.array_sort(F.collect_set("source")).alias("imports"))
    ex = exports.groupBy("file").agg(F.array_sort(F.collect_set("name")).alias("exports"))
    out = spine.join(files.select("file", "lines"), "file", "left").join(counted, "file", "left").join(ranks.select("file", "rank"), "file", "left").join(im, "file", "left").join(ex, "file", "left")
    return out.select("file", F.coalesce("lines", "_end", F.lit(0)).alias("lines"), F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("rank", F.lit(0.0)).alias("rank"), F.coalesce("imports", F.array()).alias("imports"), F.coalesce("exports", F.array()).alias("exports"))


def language_stats(symbols: DataFrame, language: str = "language", file: str = "file") -> DataFrame:
    return symbols.groupBy(language).agg(F.countDistinct(file).alias("files"), F.count("*").alias("symbols"))


def directory_summary(files: DataFrame, root: str = ".") -> DataFrame:
    return files.groupBy(top_directory(F.col("file"), root).alias("directory")).agg(F.count("*").alias("files"), F.sum(F.coalesce("symbols", F.lit(0))).alias("symbols"), F.sum(F.coalesce("lines", F.lit(0))).alias("lines"))


def tiered_top(files: DataFrame, total: int) -> DataFrame:
    """The ranked head of the index: all up to 100 files, then 200, 100 and 50 of ever larger workspaces."""
    n = total if total <= 100 else 200 if total <= 500 else 100 if total <= 2000 else 50
    return files.orderBy(F.col("rank").desc(), "file").limit(n)


def within_budget(rows: DataFrame, group: list[str], order: str, tokens: Column, budget: int, block: int = 65_536) -> DataFrame:
    """The prefix of each group, by a unique numeric column, whose running token count stays within the budget.

    Sums of blocks tell where each block starts; blocks that start beyond the budget are dropped before any row of
    them is sorted, and no group is ordered as a whole.
    """
    cut_ = rows.withColumn("_b", F.floor(F.col(order) / block)).withColumn("_t", tokens)
    before = F.sum("_s").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut_.groupBy(*group, "_b").agg(F.sum("_t").alias("_s")).withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") <= budget).drop("_s")
    inside = F.sum("_t").over(Window.partitionBy(*group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cut_.join(starts, [*group, "_b"]).withColumn("running", F.col("_before") + inside).where(F.col("running") <= budget).drop("_b", "_t", "_before")


def class_outline(symbols: DataFrame, class_name: str) -> DataFrame:
    """A class with its members."""
    own = F.col("name") == class_name
    return symbols.where(own | F.col("name").startswith(class_name + ".")).withColumn("expanded", own).orderBy("start_line", "name")


def directory_outline(symbols: DataFrame, directory: str) -> DataFrame:
    """Top-level symbols of the files under a directory, named by relative path."""
    prefix = directory.rstrip("/") + "/"
    inside = symbols.where(F.col("file").startswith(prefix) & ~F.col("name").contains("."))
    return inside.withColumn("label", F.concat(F.substring("file", len(prefix) + 1, 10_000), F.lit("::"), F.col("name"))).orderBy("file", "start_line", "name")


def member_hierarchy(symbols: DataFrame) -> DataFrame:
    """Each symbol with its parent row's id by the text before the first dot; orphans stay at the top."""
    parent = symbols.where(~F.col("name").contains(".")).select("file", F.col("name").alias("_p"), F.col("start_line").alias("parent_line")).dropDuplicates(["file", "_p"])
    own = symbols.withColumn("_p", F.when(F.col("name").contains("."), F.regexp_extract("name", r"^([^.]*)\.", 1)))
    return own.join(parent, ["file", "_p"], "left").withColumn("parent", F.when(F.col("parent_line").isNotNull(), F.col("_p"))).drop("_p")


def dependencies(code: DataFrame, members: DataFrame, cls: str = "class") -> DataFrame:
    """Distinct ``this.x`` and ``self.x`` of each class's code with the member they mean, unresolved ones as properties."""
    refs = code.select(cls, F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"\b(?:this|self)\.([A-Za-z_$][\w$]*)"), F.lit(1)))).alias("member")).distinct()
    known = members.select(cls, short_name(F.col("name")).alias("member"), "kind", F.lit(True).alias("_hit")).dropDuplicates([cls, "member"])
    out = refs.join(known, [cls, "member"], "left")
    return out.select(cls, F.when(F.col("_hit"), F.col("member")).otherwise(F.concat("member", F.lit(" (unresolved)"))).alias("member"), F.coalesce("kind", F.lit("property")).alias("kind"))
