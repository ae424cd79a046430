"""The import graph: edges, in-degree, centrality. One distinct per edge list; degrees are map-side combined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(*parts: DataFrame) -> DataFrame:
    """Distinct (src, dst) of several edge lists, without self-edges."""
    out = parts[0].select("src", "dst")
    for p in parts[1:]:
        out = out.unionByName(p.select("src", "dst"))
    return out.where("src <> dst").distinct()


def reference_edges(refs: DataFrame, definitions: DataFrame, name: str = "name") -> DataFrame:
    """(src, dst): from a file that refers to a name to every file that defines it."""
    return edges(refs.select(F.col("file").alias("src"), name).distinct().join(definitions.select(F.col("file").alias("dst"), name).distinct(), name))


def nodes(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("src").alias("file")).union(graph.select(F.col("dst").alias("file"))).distinct()


def in_degree(files: DataFrame, graph: DataFrame) -> DataFrame:
    """(file, in_degree) of each file, 0 where nothing imports it; edges are distinct, so a count suffices."""
    counted = graph.groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("in_degree"))
    return files.join(counted, "file", "left").na.fill({"in_degree": 0})


def ranks(degrees: DataFrame, entry: Column, penalty: Column, bonus: float = 5.0, factor: float = 0.3) -> DataFrame:
    """Centrality: (in-degree, plus a bonus for entry points) times a penalty, over the largest; 0 if that is 0."""
    scored = degrees.withColumn("score", (F.col("in_degree") + F.when(entry, bonus).otherwise(0.0)) * F.when(penalty, factor).otherwise(1.0))
    top = scored.agg(F.max("score").alias("top"))  # one row
    ranked = scored.crossJoin(F.broadcast(top))
    return ranked.withColumn("rank", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0)).drop("top")
