import random

from larkspur.llm import leakage as L

R = random.Random(7)
VOCABULARY = ["w%d" % i for i in range(400)]
ITEMS = [(i, [R.choice(VOCABULARY) for _ in range(60)]) for i in range(30)]
HEAD = "answer the question with code only and explain nothing at all"


def table(spark):
    return spark.createDataFrame([(i, "s", HEAD + "\n" + " ".join(w)) for i, w in ITEMS], "item_id bigint, suite string, text string")


def pairs(spark, texts):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, item_id int")
    return {(r.doc_id, r.item_id) for r in L.found(df, table(spark)).collect()}


def noise(n):
    return " ".join(R.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))


def test_what_leaks(spark):
    w = ITEMS[3][1]
    part = w[20:44]
    changed = part[:6] + ["zzz"] + part[7:15] + part[16:20] + ["extra"] + part[20:]
    styled = " ".join(x[:1].upper() + "\u00ad" + x[1:] + ("," if k % 5 == 0 else "") for k, x in enumerate(part))
    texts = [
        noise(30) + " " + " ".join(part) + " " + noise(20), " ".join(changed), styled, "<b>" + "</b> **".join(part) + "**\n", " ".join(w[2:14]) + noise(40) + " " + " ".join(w[30:42]),
        "> " + "\n> ".join(part), HEAD + " item 3", " ".join(w[5:12]), " ".join(w[30:42]) + " " + noise(9) + " " + " ".join(w[2:14]), " ".join(w[0:7]) + noise(5) + " " + " ".join(w[20:27]) + noise(5) + " " + " ".join(w[40:47]),
        " ".join(reversed(w)), None, "", " ".join(w) + " " + " ".join(ITEMS[4][1]),
    ]
    assert pairs(spark, texts) == {(0, 3), (1, 3), (2, 3), (3, 3), (4, 3), (5, 3), (13, 3), (13, 4)}


def test_myers_against_the_table():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(300):
        a, b = ([R.choice("abc") for _ in range(R.randint(0, 90))] for _ in range(2))
        assert L.myers(a, b) == plain(a, b)


def test_any_few_edits_are_found(spark):
    texts, want = [], set()
    for k in range(60):
        item, w = ITEMS[k % 30]
        s = R.randint(0, 30)
        part = w[s:s + 28]
        for _ in range(3):
            at = R.randrange(1, len(part) - 1)
            part[at:at + 1] = R.choice([[], ["new"], [part[at], "more"]])
        texts.append(noise(10) + " " + " ".join(part) + " " + noise(10))
        want.add((k, item))
    assert len(pairs(spark, texts) & want) >= 58


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    assert L.found(df.limit(0), table(spark)).count() == 0 and L.found(df, table(spark).limit(0)).count() == 0


def test_one_piece_is_enough(spark):
    """A 30-word item with as many changes as its error budget keeps one piece, and is found by it."""
    w = ["u%d" % i for i in range(30)]
    changed = [x if i % 3 != 1 or i == 13 else "other%d" % i for i, x in enumerate(w)]
    block = L.Items([(5, w)], 3)
    numbers = L.np.array([block.number.get(x, 0) for x in changed], dtype=L.np.int32)
    assert len(block.hits(numbers)[0]) == 1 and L.myers(w, changed) == 9
    items = spark.createDataFrame([(5, HEAD + "\n" + " ".join(w))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, noise(20) + " " + " ".join(changed) + " " + noise(9)), (2, " ".join(w[:3]) + " " + noise(40))], "doc_id bigint, text string")
    assert [tuple(r) for r in L.found(docs, items).collect()] == [(1, 5)]


def test_short_items(spark):
    items = spark.createDataFrame([(1, HEAD + "\n" + " ".join("s%d" % i for i in range(12))), (2, HEAD + "\n" + " ".join("t%d" % i for i in range(7)))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, noise(5) + " " + " ".join("s%d" % i for i in range(12))), (2, " ".join("s%d" % i for i in range(9))), (3, " ".join("t%d" % i for i in range(7)))], "doc_id bigint, text string")
    assert [tuple(r) for r in L.found(docs, items).collect()] == [(1, 1)]


def test_many_repeats_end_soon():
    import time

    w = ITEMS[0][1]
    block = L.Items([(0, w)], 3)
    doc = L.np.array([block.number.get(x, 0) for x in (w[:12] + ["zzz"]) * 100_000], dtype=L.np.int32)
    began = time.perf_counter()
    at, _, start = block.hits(doc)
    assert len(at) >= 400_000 and block.held(0, doc.tolist(), list(zip(at.tolist(), start.tolist())), 20, 8) == 0
    assert time.perf_counter() - began < 60


def test_blocks_of_items_agree(spark, monkeypatch):
    texts = [noise(9) + " " + " ".join(w[10:40]) for _, w in ITEMS]
    whole = pairs(spark, texts)
    monkeypatch.setattr(L, "BLOCK_WORDS", 200)
    assert pairs(spark, texts) == whole and len(whole) == len(ITEMS)


def test_two_stretches_by_brute_force():
    for _ in range(400):
        found = []
        for _ in range(R.randint(0, 7)):
            a, c, n = R.randint(0, 40), R.randint(0, 90), R.randint(4, 15)
            found.append((a, min(60, a + n), c, c + n))
        good = [x for x in found if x[1] - x[0] >= 8]
        best = max((b - a for a, b, _, _ in good), default=0)
        for a, b, _, d in good:
            for a2, b2, c2, _ in good:
                if a2 >= b - 2 and c2 >= d - 2:
                    best = max(best, b - a + max(0, b2 - max(a2, b)))
        assert L.covered(sorted(found, key=lambda x: (x[2], x)), 8, 60) == best
