"""Searching text and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .joins import asof_backward, first_interval, interval_join


BLOCK = 1000


def knn(vectors: DataFrame, query: DataFrame, id_: str, embedding: str, k: int, scope: Column | None = None) -> DataFrame:
    """The k nearest to each row of ``query`` (q_id, q): exact, the scope filtered first.

    Up to ``BLOCK`` queries are broadcast. More are dealt into blocks of about that many, and each block meets each
    split of the vectors in a task of its own; only the k best of a query in a split are shuffled.
    """
    n = query.count()
    rows = vectors if scope is None else vectors.where(scope)
    asked = F.broadcast(query) if n <= BLOCK else query.repartition(-(-n // BLOCK)).hint("shuffle_replicate_nl")
    scored = rows.crossJoin(asked).where(F.col(id_) != F.col("q_id")).withColumn("similarity", V.cosine(F.col(embedding), F.col("q")))
    scored = scored.where("similarity is not null").select("q_id", id_, F.round(V.similarity_score(1 - F.col("similarity")), 3).alias("score"), "similarity")
    if n == 1:
        return scored.orderBy(F.col("similarity").desc(), id_).limit(k).drop("similarity")
    rank = Window.partitionBy("q_id").orderBy(F.col("similarity").desc(), id_)
    return scored.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= k).drop("_n", "similarity")


def in_directory(path: Column, scope: str) -> Column:
    """A path equal to a scope or under it, whole segments only."""
    return (path == scope) | path.startswith(scope.rstrip("/") + "/")


def numbered_lines(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep, line_no, line): 1-based lines; \\r is no part of a line."""
    return rows.select(*keep, F.posexplode(F.split(F.regexp_replace(F.col(text), "\r", ""), "\n", -1)).alias("_p", "line")).withColumn("line_no", F.col("_p") + 1).drop("_p")


def grep(rows: DataFrame, text: str, pattern: str, keep: list[str], ignore_case: bool = False, glob: Column | None = None, multiline: bool = False) -> DataFrame:
    """Matching lines. Rows whose whole text doesn't match are dropped before their lines are made.

    multiline: '.' spans line breaks and the first match of each text is the result, at its first line.
    """
    flags = ("i" if ignore_case else "") + ("s" if multiline else "m")
    whole = f"(?{flags}){pattern}"
    picked = rows if glob is None else rows.where(glob)
    picked = picked.where(F.col(text).rlike(whole))
    if multiline:
        at = F.regexp_instr(F.regexp_replace(F.col(text), "\r", ""), F.lit(whole))
        before = F.substr(F.regexp_replace(F.col(text), "\r", ""), F.lit(1), at - 1)
        return picked.select(*keep, (F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1).alias("line_no"), F.regexp_extract(F.col(text), whole, 0).alias("line"))
    return numbered_lines(picked, text, keep).where(F.col("line").rlike(f"(?{'i' if ignore_case else ''}){pattern}" if ignore_case else pattern))


def grep_files(hits: DataFrame, keep: list[str]) -> DataFrame:
    return hits.select(*keep).distinct()


def grep_count(hits: DataFrame, keep: list[str]) -> DataFrame:
    return hits.groupBy(*keep).agg(F.count("*").alias("matches"))


def with_context(all_lines: DataFrame, hits: DataFrame, keep: list[str], around: int) -> DataFrame:
    """Lines at most ``around`` before or after a hit: hits are exploded to the lines they show, then joined by equality."""
    shown = hits.select(*keep, F.explode(F.sequence(F.greatest(F.col("line_no") - around, F.lit(1)), F.col("line_no") + around)).alias("line_no")).distinct()
    return all_lines.join(shown, [*keep, "line_no"])


def text_search(hits: DataFrame, symbols: DataFrame, keys: list[str], limit: int | None = None, cell: int = 256) -> DataFrame:
    """Each hit's first enclosing symbol, or the last one that starts above; one row for each symbol or bare line."""
    point = [*keys, "line_no"]
    hit = hits.select(*point, "line").distinct()
    inside = first_interval(interval_join(hit, symbols.select(*keys, "name", "start_line", "end_line"), keys, "line_no", "start_line", "end_line", cell), point, "start_line", ["name"])
    rest = hit.join(inside.select(*point), point, "left_anti")
    # the last symbol that starts at or above the line, by blocks of lines: no line meets all symbols of its file
    starts = symbols.select(F.struct(*keys).alias("_key"), F.col("start_line").alias("line_no"), "name")
    above = asof_backward(rest.withColumn("_key", F.struct(*keys)), starts.withColumn("line", F.col("name")), "_key", "line_no", "line", ["name"], cell)
    named = inside.select(*point, "line", "name").unionByName(above.select(*point, "line", "name"))
    label = F.coalesce("name", F.concat(F.lit("line "), F.col("line_no").cast("string")))
    first = Window.partitionBy(*keys, label).orderBy("line_no")
    out = named.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k").withColumn("score", F.lit(1.0))
    return out.orderBy(*keys, "line_no").limit(limit) if limit else out


def did_you_mean(names: DataFrame, column: str, asked: str, n: int = 3) -> DataFrame:
    low = F.lower(column)
    return names.where(F.contains(low, F.lit(asked.lower())) | F.contains(F.lit(asked.lower()), low)).orderBy(F.length(column), column).limit(n)


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


_DECLARES = r"\b(?:class|interface|enum|type|function|def|func|fn|struct|trait|const|let|var)\s+\*?([A-Za-z_$][\w$]*)"


def drift_lookup(wanted: DataFrame, lines: DataFrame, keys: list[str], ident: str, near: int = 20) -> DataFrame:
    """Where a name stands now that was recorded at a line: (keys, ident, name, line_no, tier).

    Tiers: 0 the recorded line names it, 1 the nearest line within ``near`` that declares it, 2 the first line of the
    file that declares it, 3 the nearest line that names it. Names of lines are exploded and joined by equality, never
    searched pair by pair. wanted: keys, ident, name (an identifier), start_line; lines: keys, line_no, line. Names
    without any line give no row; ties go to the smaller line.
    """
    named = lines.select(*keys, "line_no", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"([A-Za-z_$][\w$]*)"), 1))).alias("name"))
    declared = lines.select(*keys, "line_no", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(_DECLARES), 1))).alias("name")).withColumn("_declares", F.lit(True))
    places = named.join(declared, [*keys, "line_no", "name"], "left")
    met = wanted.select(*keys, ident, "name", "start_line").join(places, [*keys, "name"])
    away = F.abs(F.col("line_no") - F.col("start_line"))
    tier = F.when(away == 0, 0).when(F.col("_declares") & (away <= near), 1).when(F.col("_declares"), 2).otherwise(3)
    order = F.struct(tier.alias("tier"), F.when(tier == 2, 0).otherwise(away).alias("away"), F.col("line_no"))
    return met.groupBy(*keys, ident, "name").agg(F.min(order).alias("_m")).select(*keys, ident, "name", F.col("_m.line_no").alias("line_no"), F.col("_m.tier").alias("tier"))
