"""Joins beyond equality: intervals, as-of, longest prefix, first candidate. All plan as hash or sort-merge joins.

Hot keys are cut into blocks of the ordered column, so no operator holds or sorts a whole key in one task.
Null keys and null bounds match nothing; ties are broken by the named columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs of a point and each interval of its key with start <= at <= end.

    Numeric columns; intervals are laid over buckets of ``width`` and joined on (keys, bucket): an interval
    costs a row for each bucket it touches, a point costs one, and a key is spread over its buckets.
    """
    left = points.withColumn("_b", F.floor(F.col(at) / width))
    right = intervals.where(F.col(start) <= F.col(end)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return left.join(right, [*keys, "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_b")


def first_interval(pairs: DataFrame, point: list[str], start: str, ties: list[str], innermost: str | None = None) -> DataFrame:
    """One interval a point: the first by start, or with ``innermost`` (its end column) the shortest."""
    order = ([F.col(innermost) - F.col(start)] if innermost else []) + [F.col(start), *map(F.col, ties)]
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy(*point).orderBy(*order))).where("_n = 1").drop("_n")


def asof_backward(left: DataFrame, right: DataFrame, key: str, at: str, ties: str, value: list[str], block: float) -> DataFrame:
    """Each left row with the latest right row of its key at or before ``at`` (numeric); left rows without one keep nulls.

    Rows are ordered by (at, right before left, ties) inside (key, block of ``at``); what a block inherits is
    carried over from the last right row of the blocks before, a frame of one row a block.
    """
    picked = F.struct(*[F.col(c) for c in value])
    r = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key), F.col(at), F.col(ties).alias("_t"), F.lit(0).alias("_side"), picked.alias("_v"))
    keep = F.struct(*[F.col(c) for c in left.columns])
    lefts = left.select(F.col(key), F.col(at), F.col(ties).alias("_t"), F.lit(1).alias("_side"), keep.alias("_row"))
    rows = lefts.unionByName(r, allowMissingColumns=True).withColumn("_b", F.floor(F.col(at) / block))
    inside = Window.partitionBy(key, "_b").orderBy(at, "_side", "_t").rowsBetween(Window.unboundedPreceding, 0)
    lasts = r.withColumn("_b", F.floor(F.col(at) / block)).groupBy(key, "_b").agg(F.max_by("_v", F.struct(at, "_t")).alias("_last"))
    blocks = rows.select(key, "_b").distinct().join(lasts, [key, "_b"], "left")
    carried = blocks.select(key, "_b", F.last("_last", ignorenulls=True).over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    found = rows.withColumn("_m", F.last("_v", ignorenulls=True).over(inside)).where("_side = 1").join(carried, [key, "_b"], "left")
    got = F.coalesce("_m", "_carry")
    return found.select("_row.*", *[got[c].alias(c) for c in value])


def longest_prefix(rows: DataFrame, path: Column, roots: DataFrame, root: str, row_key: list[str], prefer: Column | None = None, every: bool = False) -> DataFrame:
    """Each row with the longest root that is its path or a directory above it (or ``every`` such root).

    The ancestors of a path are exploded and joined by equality: no prefix comparison of all pairs.
    """
    from ..functions.paths import ancestors

    up = rows.withColumn("_a", F.explode(ancestors(path)))
    met = up.join(roots, up["_a"] == roots[root]).drop("_a")
    if every:
        return met
    order = ([prefer.desc()] if prefer is not None else []) + [F.length(root).desc(), F.col(root)]
    return met.withColumn("_n", F.row_number().over(Window.partitionBy(*row_key).orderBy(*order))).where("_n = 1").drop("_n")


def first_candidate(rows: DataFrame, candidates: Column, known: DataFrame, known_key: str, row_key: list[str]) -> DataFrame:
    """Each row with the first of its ordered candidates that is known."""
    spread = rows.select("*", F.posexplode(candidates).alias("_p", "_c"))
    met = spread.join(known, spread["_c"] == known[known_key])
    return met.withColumn("_n", F.row_number().over(Window.partitionBy(*row_key).orderBy("_p", known_key))).where("_n = 1").drop("_n", "_c").withColumnRenamed("_p", "candidate")


def unresolved_left(refs: DataFrame, members: DataFrame, on: list[str], label: str, suffix: str = " (unresolved)") -> DataFrame:
    """References with their member, kept and marked where there is none."""
    marked = members.withColumn("_hit", F.lit(True))
    out = refs.join(marked, on, "left")
    return out.withColumn(label, F.when(F.col("_hit"), F.col(label)).otherwise(F.concat(F.col(label), F.lit(suffix)))).drop("_hit")


def children_of(parents: DataFrame, children: DataFrame, key: str, child: str, order: list[str], out: str = "children", sep: str = ", ") -> DataFrame:
    """Each parent with its children's names in order; childless parents keep an empty string."""
    listed = children.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(child).alias("_c")))), lambda x: x["_c"]), sep).alias(out), F.count("*").alias("n_" + out))
    return parents.join(listed, key, "left").na.fill({out: "", "n_" + out: 0})


def bidirectional_prefix(a: DataFrame, b: DataFrame, left: Column, right: Column) -> DataFrame:
    """Pairs of which one path lies under the other; both sides are expanded to ancestors and joined by equality."""
    from ..functions.paths import ancestors

    a = a.withColumn("_l", left)
    b = b.withColumn("_r", right)
    down = a.withColumn("_x", F.explode(ancestors(F.col("_l")))).join(b, F.col("_x") == F.col("_r")).drop("_x")
    up = b.withColumn("_x", F.explode(ancestors(F.col("_r")))).join(a, F.col("_x") == F.col("_l")).drop("_x")
    cols = [c for c in a.columns + b.columns]
    return down.select(*cols).union(up.select(*cols)).distinct().drop("_l", "_r")


def enclosing(rows: DataFrame, file: str, start: str, end: str, key: list[str], cell: int = 256) -> DataFrame:
    """Each symbol with the innermost symbol that encloses it: an interval self-join on (file, cell of lines)."""
    outer = rows.select(F.col(file), F.col(start).alias("_os"), F.col(end).alias("_oe"), F.struct(*[F.col(c) for c in key]).alias("parent"))
    pairs = interval_join(rows, outer, [file], start, "_os", "_oe", cell).where((F.col("_oe") >= F.col(end)) & (F.col("_oe") - F.col("_os") > F.col(end) - F.col(start)))
    best = first_interval(pairs, key, "_os", ["_oe"], "_oe").select(*key, "parent")
    return rows.join(best, key, "left")
