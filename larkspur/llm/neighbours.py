"""The k most similar vectors of every vector: a forest of random-projection trees.

Each tree splits the vectors by hyperplanes between two random ones, at the median. A vector searches all
trees through one shared priority queue, ordered by the largest margin on the wrong side on the way down, until it has
``leaves`` leaves; the vectors of those leaves are its candidates and are reranked by exact cosine distance. The queue
is worked level by level for a whole block of vectors: as the right side of a node keeps its priority, each of the best
``leaves`` nodes of a level leads to a leaf of its own priority, and no other node can lead to a better one.

The hyperplanes are fitted on a sample that keeps pace with the vectors, n / 128, within ``fit`` = 32,768 and
``fit_most`` = 262,144 (so the broadcast forest is bounded too, about 150 MB at most; leaves keep their size up to about
33 million vectors and grow beyond); every vector is indexed in every tree and searches for itself. Each leaf is one
unit of work: its members arrive together and its searchers are multiplied against them in blocks of ``BLOCK`` rows.
Exact copies of a vector form a class and are searched once, so copies cannot fill a leaf; large classes are met by
broadcast (there are at most ``HOT``), so no key gathers the copies of a class.

Defined results: vectors that are null, not of length ``dim``, with null, NaN or infinite numbers, or all
zero, take no part; so do null labels; a repeated row counts once, and of several vectors under one label the
smallest is taken; distances are 1 - cosine in double precision, rounded to 6 decimals, ties by smaller label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import cut

BLOCK = 1024
SALT = 64
HOT = 2000
ASKED = 20_000  # stated queries that are broadcast at once


def usable(vectors: DataFrame, dim: int = 32, label: str = "label", embedding: str = "embedding") -> DataFrame:
    """(label, v): each label once, its vector as floats if it came so (the shuffles carry them), else as doubles."""
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kind = "array<float>" if dict(vectors.dtypes)[embedding] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(label).cast("long").alias("label"), F.col(embedding).cast(kind).alias("v"))
    fine = rows.where("label is not null and v is not null").where((F.size("v") == dim) & whole & F.exists("v", lambda x: x != 0))
    return fine.groupBy("label").agg(F.min("v").alias("v"))


class Forest:
    """Random-projection trees as flat arrays, fitted on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.normals: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.kids: list[tuple[int, int]] = []  # a leaf as -1 - its number
        self.roots: list[int] = []
        self.n_leaves = 0
        for _ in range(trees):
            self.roots.append(self._grow(sample, np.arange(len(sample)), leaf, rng))
        dim = sample.shape[1] if sample.ndim == 2 else 0
        self.normals = np.array(self.normals, dtype=np.float32).reshape(-1, dim)
        self.offsets = np.array(self.offsets, dtype=np.float32)
        self.low, self.high = (np.array([kid[side] for kid in self.kids], dtype=np.int64) for side in (0, 1))

    def _grow(self, sample, idx, leaf, rng) -> int:
        if len(idx) <= leaf:
            self.n_leaves += 1
            return -self.n_leaves
        a, b = sample[rng.choice(idx, 2, replace=False)]
        normal = a - b
        size = np.linalg.norm(normal)
        normal = normal / size if size > 1e-12 else rng.normal(size=sample.shape[1])
        side = sample[idx] @ normal
        cut = float(np.median(side))
        low = side < cut
        if low.all() or not low.any():
            low = rng.random(len(idx)) < 0.5
        at = len(self.kids)
        self.kids.append((0, 0))
        self.normals.append(normal)
        self.offsets.append(cut)
        self.kids[at] = (self._grow(sample, idx[low], leaf, rng), self._grow(sample, idx[~low], leaf, rng))
        return at

    def best(self, vectors: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
        """(leaves, priorities) of each vector: those of smallest margin on the wrong side over all trees, -1 where there are fewer.

        Priority 0 marks the leaf that holds the vector in its tree.
        """
        rows = np.arange(len(vectors))[:, None]
        node = np.tile(np.array(self.roots, dtype=np.int64), (len(vectors), 1))
        cost = np.zeros(node.shape, dtype=np.float32)
        whole = vectors @ self.normals.T - self.offsets if 0 < len(self.kids) <= 8192 else None
        while len(self.kids) and (node >= 0).any():
            inner = node >= 0
            at = np.where(inner, node, 0)
            if whole is not None:
                m = whole[rows, at]
            else:
                m = np.einsum("ijk,ik->ij", self.normals[at], vectors) - self.offsets[at]
            m = np.where(inner, m, np.float32(0)).astype(np.float32)
            low = np.where(inner, self.low[at], node)  # a leaf stands for itself
            high = np.where(inner, self.high[at], -(1 << 40))
            node = np.concatenate([low, high], axis=1)
            # on the wrong side of a hyperplane the margin counts; 0 belongs to the upper side
            cost = np.concatenate([np.maximum(cost, np.where(inner & (m >= 0), np.maximum(m, np.float32(1e-30)), 0)), np.where(inner, np.maximum(cost, np.where(m < 0, -m, 0)), np.float32(np.inf))], axis=1)
            width = max(leaves, len(self.roots))
            if node.shape[1] > width:
                keep = np.argpartition(cost, width - 1, axis=1)[:, :width]
                node, cost = node[rows, keep], cost[rows, keep]
        order = np.argsort(cost, axis=1, kind="stable")[:, :max(leaves, len(self.roots))]
        node, cost = node[rows, order], cost[rows, order]
        return np.where(np.isfinite(cost), -1 - node, -1), cost


def _plain(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column as they are."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    v = vectors.astype(np.float64)
    scale = np.abs(v).max(axis=1, keepdims=True, initial=0.0)
    v /= np.where(scale > 0, scale, 1.0)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _pack(rows: np.ndarray) -> pa.Array:
    """Rows of an array as binary values, which the JVM moves without looking into them."""
    data = np.ascontiguousarray(rows)
    width = data.dtype.itemsize * int(np.prod(data.shape[1:]))
    return pa.Array.from_buffers(pa.binary(width), len(data), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _unpack(column: pa.Array, dtype, width: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)
    return flat.reshape(-1, width) if width else flat


HIT = np.dtype([("d", "<f8"), ("o", "<i8")])


def _top(ids: np.ndarray, asked: np.ndarray, members: np.ndarray, base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asking row, member, distance), in order, of the k nearest members of each asking vector; members are in label order.

    Candidates are screened in single precision with room for its error, then measured in double precision.
    """
    near = asked.astype(np.float32) @ base.astype(np.float32).T
    near[ids[:, None] == members[None, :]] = -np.inf
    if k < len(members):
        kth = -np.partition(-near, k - 1, axis=1)[:, k - 1:k]
        r, c = np.nonzero(near >= kth - np.float32(3e-6))
    else:
        r, c = np.nonzero(np.isfinite(near))
    fine = np.isfinite(near[r, c])
    r, c = r[fine], c[fine]
    d = np.round(1.0 - np.einsum("ij,ij->i", asked[r], base[c]), 6) + 0.0
    o = np.lexsort((c, d, r))  # members are in label order: ties go to the smaller label
    r, c, d = r[o], c[o], d[o]
    keep = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
    return r[keep], c[keep], d[keep]


def _runs(batches: Iterator[pa.RecordBatch], most: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches regrouped so that rows of one key (column 0, sorted) stay together; with ``most``, several keys at once."""
    parts: list[pa.RecordBatch] = []
    held = 0

    def joined():
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        if parts and parts[-1].column(0)[-1].as_py() != ids[0] and held >= most:
            yield joined()
            parts, held = [], 0
        if most:  # all but the last key are whole
            last = cuts[-2]
            if last and held + last >= most:
                parts.append(batch.slice(0, last))
                yield joined()
                parts, held = [batch.slice(last)], len(ids) - last
            else:
                parts.append(batch)
                held += len(ids)
            continue
        for s, e in zip(cuts, cuts[1:]):
            if parts and parts[-1].column(0)[-1].as_py() != ids[s]:
                yield joined()
                parts = []
            parts.append(batch.slice(s, e - s))
    if parts:
        yield joined()


def nearest(points: DataFrame, k: int = 5, dim: int = 32, trees: int = 16, leaf: int = 512, leaves: int = 40, fit: int = 32_768, fit_most: int = 262_144, queries=None) -> DataFrame:
    """(label, other, distance): the k nearest of each vector of ``points`` (label, v), all distinct in v.

    queries: a condition on label; only those vectors search, against all.
    """
    spark = points.sparkSession
    total = points.count()
    fit = max(fit, min(fit_most, total // 128))
    sample = points.orderBy(F.xxhash64("label")).limit(fit) if total > fit else points
    table = sample.select("v").toArrow().combine_chunks().to_batches()
    unit = _unit(_plain(table[0].column(0), dim)) if table else np.zeros((0, dim))
    per_leaf = max(4, int(leaf * len(unit) / max(total, 1)))
    forest = spark.sparkContext.broadcast(Forest(unit, trees, per_leaf))
    dtype = "<f4" if dict(points.dtypes)["v"] == "array<float>" else "<f8"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                b = whole.slice(start, 2048)
                labels = b.column(0).to_numpy(zero_copy_only=False)
                vectors = _plain(b.column(1), dim).astype(dtype)
                found, cost = f.best(_unit(vectors).astype(np.float32), leaves)
                asks = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
                home = (cost == 0) & (found >= 0)
                want = (found >= 0) & asks[:, None]
                want[:, leaves:] = False
                rows, col = np.nonzero(home | want)
                roles = home[rows, col] + 2 * want[rows, col]
                yield pa.RecordBatch.from_arrays([pa.array(found[rows, col]), pa.array(labels[rows], pa.int64()), _pack(vectors[rows]), pa.array(roles, pa.int32())], names=["leaf", "label", "v", "role"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            labels = run.column(1).to_numpy(zero_copy_only=False)
            vectors = _unit(_unpack(run.column(2), dtype, dim))
            role = run.column(3).to_numpy(zero_copy_only=False)
            holds, wants = (role & 1) > 0, (role & 2) > 0
            order = np.argsort(labels[holds], kind="stable")
            members, base = labels[holds][order], vectors[holds][order]
            asking, asked = labels[wants], vectors[wants]
            for s in range(0, len(asking), BLOCK):
                ids = asking[s:s + BLOCK]
                r, c, d = _top(ids, asked[s:s + BLOCK], members, base, k)
                best = np.zeros((len(ids), k), dtype=HIT)
                best["d"] = np.inf
                best[r, np.arange(len(r)) - np.searchsorted(r, r, side="left")] = np.rec.fromarrays([d, members[c]], dtype=HIT)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _pack(best)], names=["label", "best"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 16_384):
            hits = _unpack(run.column(1), HIT, 0)
            labels = np.repeat(run.column(0).to_numpy(zero_copy_only=False), len(hits) // run.num_rows)
            real = np.isfinite(hits["d"])
            hits, labels = hits[real], labels[real]
            o = np.lexsort((hits["o"], hits["d"], labels))
            hits, labels = hits[o], labels[o]
            fresh = np.ones(len(labels), bool)  # a pair met in several leaves has one distance
            fresh[1:] = (labels[1:] != labels[:-1]) | (hits["o"][1:] != hits["o"][:-1]) | (hits["d"][1:] != hits["d"][:-1])
            hits, labels = hits[fresh], labels[fresh]
            keep = np.arange(len(labels)) - np.searchsorted(labels, labels, side="left") < k
            yield pa.RecordBatch.from_arrays([pa.array(labels[keep], pa.int64()), pa.array(hits["o"][keep], pa.int64()), pa.array(hits["d"][keep])], names=["label", "other", "distance"])

    asks = points.select("label", "v", (F.lit(True) if queries is None else queries).alias("asks"))
    placed = asks.mapInArrow(assign, "leaf bigint, label bigint, v binary, role int")
    ranked = placed.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(rerank, "label bigint, best binary")
    return ranked.repartition("label").sortWithinPartitions("label").mapInArrow(merge, "label bigint, other bigint, distance double")


def _meet(many: DataFrame, one: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Joins rows with the one row of their key; keys of more than one ``HOT``-th of ``total`` rows (column n) by broadcast."""
    hot = f"n * {HOT} > {total}"
    large = F.broadcast(one.where(hot).drop("n"))
    return many.join(large, keys).unionByName(many.join(large, keys, "left_anti").join(one.where(f"not ({hot})").drop("n"), keys))


def classes(points: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(reps: label, v), (members: label, rep), (tops: rep, n, the k + 1 smallest labels) of exact copies, and their number.

    A class may hold a third of all rows: its smallest labels are found salted, its members are never gathered.
    """
    keyed = points.withColumn("key", F.xxhash64("v"))
    reps = cut(keyed.groupBy("key", "v").agg(F.min("label").alias("rep"), F.count("*").alias("n")))
    total = reps.agg(F.sum("n")).first()[0] or 0
    members = _meet(keyed, reps, ["key", "v"], total).select("label", "rep")
    first = Window.partitionBy("rep", F.pmod(F.xxhash64("label"), F.lit(SALT))).orderBy("label")
    second = Window.partitionBy("rep").orderBy("label")
    tops = members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    tops = tops.withColumn("r", F.row_number().over(second)).where(F.col("r") <= k + 1)
    labels = tops.groupBy("rep").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    return reps.select(F.col("rep").alias("label"), "v"), members, labels.join(reps.select("rep", "n"), "rep"), total


def neighbours(vectors: DataFrame, k: int = 5, dim: int = 32, **forest) -> DataFrame:
    """(label, other, distance): the k nearest of every usable vector, copies included."""
    points = usable(vectors, dim)
    reps, members, tops, total = classes(points, k)
    near = nearest(reps, k, dim, **forest)
    own = tops.select(F.col("rep").alias("label"), F.col("rep").alias("other"), F.lit(0.0).alias("distance"))
    listed = near.unionByName(own).join(tops, F.col("other") == tops["rep"]).select("label", "distance", F.explode("labels").alias("other"))
    # at most (k + 1) classes of k + 1 labels each
    ranked = listed.groupBy("label").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "other"))), 1, k + 1).alias("b"))
    ranked = ranked.withColumnRenamed("label", "rep").join(tops.select("rep", "n"), "rep")
    each = _meet(members, ranked, ["rep"], total)
    kept = F.slice(F.filter("b", lambda x: x["other"] != F.col("label")), 1, k)
    return each.select("label", F.inline(kept)).select("label", "other", "distance")


def found(vectors: DataFrame, k: int = 5, dim: int = 32) -> DataFrame:
    """(label_a, label_b), label_a < label_b, of which one is among the k nearest of the other."""
    return neighbours(vectors, k, dim).select(F.least("label", "other").alias("label_a"), F.greatest("label", "other").alias("label_b")).distinct()


def exact(vectors: DataFrame, k: int = 5, dim: int = 32, every: int = 50) -> DataFrame:
    """(label, other, distance) of the labels divisible by ``every`` against all rows: a stated query set.

    The queries are counted and dealt by hash into blocks of about ``ASKED``; each block is broadcast and meets all rows in
    one scan, and keeps k rows a query and slice of rows.
    """
    points = usable(vectors, dim).select("label", F.col("v").cast("array<double>").alias("v"))
    asks = points.where(F.col("label") % every == 0)
    blocks = -(-asks.count() // ASKED) or 1

    def against(held):
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, base = held.value
            for whole in batches:
                for start in range(0, whole.num_rows, BLOCK):
                    b = whole.slice(start, BLOCK)
                    labels = b.column(0).to_numpy(zero_copy_only=False)
                    order = np.argsort(labels, kind="stable")
                    labels, rows = labels[order], _unit(_plain(b.column(1), dim))[order]
                    for s in range(0, len(ids), BLOCK):
                        r, c, d = _top(ids[s:s + BLOCK], base[s:s + BLOCK], labels, rows, k)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[s + r]), pa.array(d), pa.array(labels[c])], names=["label", "distance", "other"])

        return score

    scored = None
    for block in range(blocks):
        table = asks.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == block).toArrow().combine_chunks()
        chunk = table.to_batches()[0] if table.num_rows else None
        ids = chunk.column(0).to_numpy(zero_copy_only=False) if chunk else np.zeros(0, np.int64)
        base = _unit(_plain(chunk.column(1), dim)) if chunk else np.zeros((0, dim))
        part = points.mapInArrow(against(points.sparkSession.sparkContext.broadcast((ids, base))), "label bigint, distance double, other bigint")
        scored = part if scored is None else scored.unionByName(part)
    rank = Window.partitionBy("label").orderBy("distance", "other")
    return scored.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= k).select("label", "other", "distance")


def recall(vectors: DataFrame, k: int = 5, dim: int = 32, every: int = 50) -> DataFrame:
    """One row: queries, true neighbours, those the forest has, recall."""
    truth = exact(vectors, k, dim, every)
    got = neighbours(vectors, k, dim).where(F.col("label") % every == 0).select("label", "other", F.lit(1).alias("hit"))
    return truth.join(got, ["label", "other"], "left").agg(
        F.countDistinct("label").alias("queries"), F.count("*").alias("neighbours"), F.count("hit").alias("hits"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"),
    )
