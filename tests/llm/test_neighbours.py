import numpy as np

from larkspur.llm import neighbours as N


def brute(rows, k):
    d = {label: np.array(v, float) for label, v in rows}
    labels = np.array(sorted(d))
    m = np.array([d[x] for x in labels])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    dist = np.round(1 - m @ m.T, 6) + 0.0
    np.fill_diagonal(dist, np.inf)
    return {(int(labels[i]), int(labels[j])) for i in range(len(labels)) for j in np.argsort(dist[i], kind="stable")[:k] if np.isfinite(dist[i, j])}


def frame(spark, rows):
    return spark.createDataFrame([(i, [None if x is None else float(x) for x in v] if v is not None else None, "x") for i, v in rows], "label bigint, embedding array<float>, v string")


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8))
    rows = [(i, np.float32(centres[i % 20] + 0.3 * rng.normal(size=8)).tolist()) for i in range(1200)]
    got = {(r.label, r.other) for r in N.neighbours(frame(spark, rows), 5, 8, leaf=64, leaves=24).collect()}
    want = brute(rows, 5)
    assert len(got) == len(want) and len(got & want) / len(want) > 0.98
    sampled = {(r.label, r.other) for r in N.neighbours(frame(spark, rows), 5, 8, leaf=64, leaves=24, fit=300).collect()}
    assert len(sampled & want) / len(want) > 0.9


def test_exact_and_recall_queries(spark):
    rng = np.random.default_rng(2)
    rows = [(i, np.float32(rng.normal(size=32)).tolist()) for i in range(300)]
    df = frame(spark, rows)
    assert {(r.label, r.other) for r in N.exact(df).collect()} == {p for p in brute(rows, 5) if p[0] % 50 == 0}
    assert N.recall(df).first().recall == 1.0


def test_copies_ties_and_unusable_vectors(spark):
    same, other = [1.0, 0.0], [0.0, 1.0]
    rows = [(i, same) for i in (9, 3, 5, 7, 1, 2, 8)] + [(20, other), (20, other), (30, None), (31, [1.0]), (32, [0.0, 0.0]), (33, [float("nan"), 1.0]), (34, [None, 1.0]), (35, [float("inf"), 1.0]), (None, same)]
    got = {}
    for r in N.neighbours(frame(spark, rows), 3, 2).collect():
        got.setdefault(r.label, []).append((r.distance, r.other))
    assert set(got) == {9, 3, 5, 7, 1, 2, 8, 20}
    assert sorted(got[9]) == [(0.0, 1), (0.0, 2), (0.0, 3)] and sorted(got[1]) == [(0.0, 2), (0.0, 3), (0.0, 5)] and sorted(got[20]) == [(1.0, 1), (1.0, 2), (1.0, 3)]
    assert all(r.label_a < r.label_b for r in N.found(frame(spark, rows), 3, 2).collect())
    assert N.found(frame(spark, []), 3, 2).count() == 0 and N.found(frame(spark, [(1, same)]), 3, 2).count() == 0


def test_level_by_level_is_the_priority_queue():
    import heapq

    rng = np.random.default_rng(5)
    sample = N._unit(rng.normal(size=(600, 6)))
    forest = N.Forest(sample, 5, 20)
    found, cost = forest.best(sample.astype(np.float32), 12)
    for i in range(0, 600, 7):
        queue, got = [(0.0, root) for root in forest.roots], []
        heapq.heapify(queue)
        while queue and len(got) < 12:
            p, node = heapq.heappop(queue)
            if node < 0:
                got.append((p, -1 - node))
                continue
            m = float(forest.normals[node] @ sample[i].astype(np.float32) - forest.offsets[node])
            low, high = forest.kids[node]
            heapq.heappush(queue, (max(p, m), low))
            heapq.heappush(queue, (max(p, -m), high))
        assert np.allclose([p for p, _ in got], cost[i][:12], atol=1e-5)
        assert {x for p, x in got if p < got[-1][0] - 1e-5} <= set(found[i][:12].tolist())
        assert (cost[i] == 0).sum() == 5


def test_blocks_of_queries_and_hot_classes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    same = np.float32(rng.normal(size=4)).tolist()
    rows = [(i, same if i % 3 == 0 else np.float32(rng.normal(size=4)).tolist()) for i in range(240)]
    df, want = frame(spark, rows), brute(rows, 5)
    monkeypatch.setattr(N, "ASKED", 7)
    assert {(r.label, r.other) for r in N.exact(df, 5, 4, every=8).collect()} == {p for p in want if p[0] % 8 == 0}
    for hot in (2, 2000):
        monkeypatch.setattr(N, "HOT", hot)
        assert {(r.label, r.other) for r in N.neighbours(df, 5, 4).collect()} == want
