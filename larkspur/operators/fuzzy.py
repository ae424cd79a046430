"""Finding an edit's old text when it doesn't stand there exactly, and applying edits.

``locate`` tries seven comparisons in order (exact, trimmed lines, anchored block, white space, indentation,
escapes, typography); the first that gives one place, or one near the hint, decides. All of it is per row and
runs Arrow batch by batch; nothing touches a disk.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import TYPOGRAPHY_FROM, TYPOGRAPHY_TO

NEAR = 5
_SIGNS = str.maketrans(TYPOGRAPHY_FROM[:-1], TYPOGRAPHY_TO[:-1])


def distance(a: str, b: str, most: int) -> int:
    """Edit distance, most + 1 if larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def _dedent(lines: list[str]) -> list[str]:
    widths = [len(x) - len(x.lstrip(" \t")) for x in lines if x.strip()]
    cut = min(widths, default=0)
    return [x[cut:] if x.strip() else "" for x in lines]


def _windows(text: str, old: str, change: Callable[[list[str]], list[str]]) -> list[tuple[int, int]]:
    """Line ranges of the text that equal the old text after the same change."""
    lines, want = text.split("\n"), old.strip("\n").split("\n")
    target, n = change(want), len(want)
    return [(i, i + n) for i in range(len(lines) - n + 1) if change(lines[i:i + n]) == target]


def _anchored(text: str, old: str) -> list[tuple[int, int]]:
    lines, want = text.split("\n"), old.strip("\n").split("\n")
    if len(want) < 3:
        return []
    first, last, body = want[0].strip(), want[-1].strip(), "\n".join(x.strip() for x in want)
    most, out = int(0.15 * len(body)), []
    ends = [j for j, x in enumerate(lines) if x.strip() == last]
    for i, x in enumerate(lines):
        if x.strip() == first:
            for j in ends:
                if len(want) - 1 <= j - i + 1 <= len(want) + 5 and distance("\n".join(y.strip() for y in lines[i:j + 1]), body, most) <= most:
                    out.append((i, j + 1))
    return out


def _escapes(x: str) -> str:
    return re.sub(r"\\([ntr\"'\\])", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), x)


STRATEGIES: list[tuple[str, Callable[[str, str], list[tuple[int, int]]]]] = [
    ("trimmed", lambda t, o: _windows(t, o, lambda ls: [x.strip() for x in ls])),
    ("anchored", _anchored),
    ("whitespace", lambda t, o: _windows(t, o, lambda ls: [" ".join(x.split()) for x in ls])),
    ("indentation", lambda t, o: _windows(t, o, _dedent)),
    ("escapes", lambda t, o: _windows(t, _escapes(o), lambda ls: [_escapes(x) for x in ls])),
    ("typography", lambda t, o: _windows(t, o, lambda ls: [x.replace("…", "...").translate(_SIGNS) for x in ls])),
]


def _choose(places: list[int], hint: int | None) -> int | None:
    """The only place, or the one nearest to the hinted line; places are 0-based lines."""
    if len(places) == 1:
        return 0
    if hint is None:
        return None
    near = sorted((abs(p + 1 - hint), i) for i, p in enumerate(places))
    return near[0][1] if near and near[0][0] <= NEAR else None


def locate(text: str, old: str, hint: int | None = None) -> tuple[str, int, int] | None:
    """(strategy, from, to) as character offsets, or None: absent or ambiguous."""
    if not old:
        return None
    exact, at = [], text.find(old)
    while at >= 0:
        exact.append(at)
        at = text.find(old, at + 1)
    if exact:
        k = _choose([text.count("\n", 0, p) for p in exact], hint)
        return None if k is None else ("exact", exact[k], exact[k] + len(old))
    starts = [0]
    for x in text.split("\n"):
        starts.append(starts[-1] + len(x) + 1)
    for name, find in STRATEGIES:
        places = find(text, old)
        if places:
            k = _choose([p[0] for p in places], hint)
            if k is not None:
                i, j = places[k]
                return name, starts[i], starts[j] - 1
    return None


def replace(text: str, old: str, new: str, hint: int | None = None) -> tuple[str, str]:
    """(text after the edit, strategy), or the text as it was and 'none'."""
    found = locate(text, old, hint)
    if found is None:
        return text, "none"
    name, a, b = found
    return text[:a] + (new if name == "exact" else new.strip("\n")) + text[b:], name


def apply_edits(rows: DataFrame) -> DataFrame:
    """Rows with content and edits (array of struct old_text, new_text, line_hint): adds result and strategies.

    Edits of a row apply one after the other to the changed text; null content gives null.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("result", T.StringType()), T.StructField("strategies", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            results, used = [], []
            for text, edits in zip(pdf["content"], pdf["edits"]):
                names = []
                if text is not None:
                    for e in edits if edits is not None else []:
                        hint = e["line_hint"]
                        text, name = replace(text, e["old_text"] or "", e["new_text"] or "", None if pd.isna(hint) else int(hint))
                        names.append(name)
                results.append(text)
                used.append(names)
            yield pdf.assign(result=results, strategies=used)

    return rows.mapInPandas(run, schema)


def apply_positions(rows: DataFrame, edits: DataFrame, key: str = "file") -> DataFrame:
    """Text edits by (start, end) offsets, from the last to the first, as one fold a file; overlaps keep the earlier one."""
    listed = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "text")), lambda a, b: (b["start"] - a["start"]).cast("int")).alias("_e"))
    step = lambda acc, e: F.concat(F.substr(acc, F.lit(1), e["start"]), e["text"], F.substr(acc, e["end"] + 1))
    out = rows.join(listed, key, "left")
    return out.withColumn("result", F.when(F.col("_e").isNull(), F.col("content")).otherwise(F.aggregate("_e", F.col("content"), step))).drop("_e")


def sliding_blocks(lines: DataFrame, keys: list[str], n: int, change=F.trim) -> DataFrame:
    """(keys, line_no, block): every run of n neighbouring lines after a change of each line."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(0, n - 1)
    got = lines.withColumn("_list", F.collect_list(change(F.col("line"))).over(w)).where(F.size("_list") == n)
    return got.select(*keys, "line_no", F.array_join("_list", "\n").alias("block"))


#: ids of a name that meet those of another name at once
BLOCK = 1024


def near_names(rows: DataFrame, group: str, name: str, id_: str, most: int) -> DataFrame:
    """Pairs of names of a group within an edit distance: (group, a, b, distance), a < b by id.

    Distinct names of a group are compared once, by deletion neighbourhoods of pieces: names are cut into most + 1
    pieces, and only names that share a piece at about the same place are compared. The ids of near names then meet in
    blocks, dealt over the tasks, so that neither a hot group nor a hot name is left to one task. Repeated rows count
    each; a null group, name or id has no pairs.
    """
    named = rows.select(group, F.col(id_).alias("_id"), F.col(name).alias("_name")).dropna()
    counts = named.groupBy(group, "_name").agg(F.count("*").alias("_n"))
    near = _near(counts.select(group, "_name"), group, most)
    block = F.pmod(F.xxhash64("_id"), F.ceil(F.col("_n") / BLOCK)).alias("_block")
    blocks = named.join(counts, [group, "_name"]).select(group, "_name", block, "_id").groupBy(group, "_name", "_block").agg(F.collect_list("_id").alias("_ids"))
    others = blocks.select(group, F.col("_name").alias("_name2"), F.col("_block").alias("_block2"), F.col("_ids").alias("_ids2"))
    met = near.join(blocks, [group, "_name"]).join(others, [group, "_name2"])
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    met = met.where("_name < _name2 or _block <= _block2").repartition(tasks, group, "_name", "_name2", "_block", "_block2")
    # inside a block each two ids meet twice and the filter keeps one of both; else once, in either order
    once = (F.col("_name") == F.col("_name2")) & (F.col("_block") == F.col("_block2"))
    pairs = met.select(group, "distance", once.alias("_inside"), F.explode("_ids").alias("_a"), "_ids2").select(group, "distance", "_inside", "_a", F.explode("_ids2").alias("_b"))
    kept = pairs.where("if(_inside, _a < _b, _a != _b)")
    return kept.select(group, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "distance")


def _near(names: DataFrame, group: str, most: int) -> DataFrame:
    """(group, _name, _name2, distance) of distinct names, _name <= _name2, each with itself too."""
    n = most + 1
    size = F.length("_name")
    lo = lambda i: F.floor(size * i / n).cast("int")
    pieces = F.array(*[F.struct(F.lit(i).alias("k"), F.substr("_name", lo(i) + 1, lo(i + 1) - lo(i)).alias("piece")) for i in range(n)])
    left = names.select(group, "_name", size.alias("_len"), F.inline(pieces))
    right = names.select(group, F.col("_name").alias("_name2"), F.explode(F.sequence(F.greatest(size - most, F.lit(0)), size + most)).alias("_len"))
    probe = right.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(n)])))
    probe = probe.withColumn("at0", F.floor(F.col("_len") * F.col("k") / n).cast("int")).withColumn("want", (F.floor(F.col("_len") * (F.col("k") + 1) / n) - F.floor(F.col("_len") * F.col("k") / n)).cast("int"))
    probe = probe.withColumn("shift", F.explode(F.sequence(F.lit(-most), F.lit(most)))).where(F.col("at0") + F.col("shift") >= 0)
    probe = probe.withColumn("piece", F.substr("_name2", F.col("at0") + F.col("shift") + 1, F.col("want"))).where(F.length("piece") == F.col("want"))
    met = left.join(probe, [group, "_len", "k", "piece"]).where("_name < _name2").select(group, "_name", "_name2").distinct()
    scored = met.withColumn("distance", F.levenshtein("_name", "_name2", most)).where("distance >= 0")
    return scored.union(names.select(group, "_name", F.col("_name").alias("_name2"), F.lit(0)))
