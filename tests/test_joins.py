import random

from pyspark.sql import functions as F

from larkspur.functions import paths
from larkspur.operators import graph, index, joins, search, timeline


def test_interval_join_against_loops(spark):
    r = random.Random(3)
    points = [(r.choice("ab"), i, r.randint(0, 300)) for i in range(200)] + [(None, 900, 5)]
    spans = [(r.choice("ab"), i, s := r.randint(0, 300), s + r.randint(-2, 60)) for i in range(60)]
    p = spark.createDataFrame(points, "k string, id int, at int")
    q = spark.createDataFrame(spans, "k string, sid int, s int, e int")
    got = {(x.id, x.sid) for x in joins.interval_join(p, q, ["k"], "at", "s", "e", 16).collect()}
    assert got == {(i, j) for k, i, at in points for k2, j, s, e in spans if k == k2 and s <= at <= e}
    pairs = joins.interval_join(p, q, ["k"], "at", "s", "e", 16)
    inner = {x.id: x.sid for x in joins.first_interval(pairs, ["id"], "s", ["sid"], "e").collect()}
    for i, sid in inner.items():
        at, k = next((a, k) for k, j, a in points if j == i)
        assert sid == min((e - s, s, j) for k2, j, s, e in spans if k2 == k and s <= at <= e)[2]


def test_asof_against_loops(spark):
    r = random.Random(5)
    left = [(i, r.choice([1, 1, 1, 2, 3]), r.randint(0, 1000)) for i in range(300)]
    right = [(1000 + i, r.choice([1, 1, 2]), r.randint(0, 1000)) for i in range(100)]
    l = spark.createDataFrame(left, "id int, k int, at bigint")  # noqa: E741
    q = spark.createDataFrame(right, "rid int, k int, at bigint").withColumn("id", F.col("rid"))
    got = {x.id: x.rid for x in joins.asof_backward(l, q, "k", "at", "id", ["rid"], 64).collect()}
    assert got == {i: max(((a, j) for j, k2, a in right if k2 == k and a <= at), default=(0, None))[1] for i, k, at in left}


def test_longest_prefix_needs_whole_segments(spark):
    f = spark.createDataFrame([(1, "src/auth/a.ts"), (2, "src/authz/b.ts"), (3, "lib/c.ts")], "id int, path string")
    roots = spark.createDataFrame([("src",), ("src/auth",)], "root string")
    assert {(x.id, x.root) for x in joins.longest_prefix(f, F.col("path"), roots, "root", ["id"]).collect()} == {(1, "src/auth"), (2, "src")}
    a, b = spark.createDataFrame([("/x/y",), ("/q",)], "p string"), spark.createDataFrame([("/x",), ("/x/y/z",)], "r string")
    assert {tuple(x) for x in joins.bidirectional_prefix(a, b, F.col("p"), F.col("r")).collect()} == {("/x/y", "/x"), ("/x/y", "/x/y/z")}


def thin(events, gap):
    out, last = set(), {}
    for k, at, i in sorted(events, key=lambda x: (str(x[0]), x[1], x[2])):
        if k not in last or at - last[k] >= gap:
            out.add(i)
            last[k] = at
    return out


def test_thinning_against_a_loop_whatever_the_blocks(spark):
    r = random.Random(11)
    events = [(r.choice(["hot"] * 8 + ["cold", None]), r.randint(0, 5000), i) for i in range(1500)]
    df = spark.createDataFrame(events, "k string, at bigint, id int")
    for gap, block in ((10, 40), (37, 100), (100, 5000), (1, 50), (400, 900)):
        assert {x.id for x in timeline.thin(df, "k", "at", "id", gap, block).collect()} == thin(events, gap), (gap, block)
    assert timeline.thin(df.limit(0), "k", "at", "id", 5).count() == 0


def test_debounce_against_a_loop(spark):
    r = random.Random(2)
    events = [(r.choice("aab"), r.randint(0, 3000), i) for i in range(400)]
    want, after = set(), {}
    for k, at, i in sorted(events, key=lambda x: (x[1], x[2]), reverse=True):
        if k not in after or after[k] - at >= 20:
            want.add(i)
        after[k] = at
    df = spark.createDataFrame(events, "k string, at bigint, id int")
    assert {x.id for x in timeline.debounce(df, "k", "at", "id", 20, 100).collect()} == want


def test_index_upkeep(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "file string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("d", 1)], "file string, v int")
    diff = index.snapshot_diff(old, new, "file", "v")
    assert {tuple(x) for x in diff.collect()} == {("a", "unchanged"), ("b", "updated"), ("c", "removed"), ("d", "added")}
    assert {tuple(x) for x in index.maintain(old, diff, new).collect()} == {("a", 1), ("b", 2), ("d", 1)}
    assert {tuple(x) for x in index.upsert(old, new, ["file"]).collect()} == {("a", 1), ("b", 2), ("c", 1), ("d", 1)}


SYMBOLS = [("A", "src/x.ts", 1, 20), ("A.run", "src/x.ts", 3, 8), ("helper", "src/y.ts", 1, 4), ("Arun", "lib/x.ts", 2, 2)]


def test_resolver_tiers(spark):
    s = spark.createDataFrame(SYMBOLS, "name string, file string, start_line int, end_line int")
    name = lambda q: {(x.name, x.tier) for x in index.resolve(s, q).collect()}
    assert name("A") == {("A", 1)} and name("run") == {("A.run", 2)} and name("help") == {("helper", 3)}
    assert name("x.ts:5") == {("A.run", 1)} and name("src/x.ts:run") == {("A.run", 2)} and name("nothing") == set()
    assert {x.name: x.parent for x in index.member_hierarchy(s).collect()} == {"A": None, "A.run": "A", "helper": None, "Arun": None}
    assert [x.name for x in index.class_outline(s, "A").collect()] == ["A", "A.run"]


def test_search_inside_and_above(spark):
    text = "\n".join(["x"] * 4 + ["hit", "x", "x"] + ["x"] * 14 + ["hit"])
    files = spark.createDataFrame([("src/x.ts", text), ("e", None), ("f", "")], "file string, text string")
    s = spark.createDataFrame(SYMBOLS, "name string, file string, start_line int, end_line int")
    hits = search.grep(files, "text", "hit", ["file"])
    assert [(x.line_no, x.name) for x in search.text_search(hits, s, ["file"]).orderBy("line_no").collect()] == [(5, "A"), (22, "A.run")]
    all_lines = search.numbered_lines(files, "text", ["file"])
    assert [x.line_no for x in search.with_context(all_lines, hits, ["file"], 1).orderBy("line_no").collect()] == [4, 5, 6, 21, 22]


def test_ranks_and_empty_graph(spark):
    e = graph.edges(spark.createDataFrame([("a", "b"), ("c", "b"), ("a", "a"), ("a", "b")], "src string, dst string"))
    d = graph.in_degree(spark.createDataFrame([("a",), ("b",), ("c",)], "file string"), e)
    assert {x.file: x.rank for x in graph.ranks(d, F.col("file") == "a", F.col("file") == "b").collect()} == {"a": 1.0, "b": 0.6 / 5, "c": 0.0}
    assert {x.rank for x in graph.ranks(d.withColumn("in_degree", F.lit(0)), F.lit(False), F.lit(False)).collect()} == {0.0}


def test_paths(spark):
    row = spark.createDataFrame([("a/./b/../c.TS", "x")], "p string, q string").select(
        paths.fold_dots(F.col("p")), paths.extension(F.col("p")), paths.language(F.col("p")), paths.directory(F.col("q")), paths.ancestors(F.lit("a/b")), paths.top_directory(F.col("q"))
    ).first()
    assert list(row) == ["a/c.TS", "ts", "typescript", "", ["a/b", "a", ""], "."]
