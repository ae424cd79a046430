import random
from collections import Counter

from larkspur.llm import handwritten as H
from larkspur.llm import mixing as M
from larkspur.llm import webspam as W

R = random.Random(3)
PROSE = ["The parser reads the whole file before it writes the index.", "We found that a lock is held while the queue drains, so the worker waits for it.", "If the path is missing, the tool reports the error and goes on with the next one.", "Older versions kept the record in memory, which was slow for large trees."]


def keywords(n):
    return ", ".join(f"{R.choice(['buy', 'cheap', 'best', 'free'])} {R.choice(['git client', 'desk lamp'])}" for _ in range(n))


def test_pages(spark):
    prose = "\n".join(PROSE * 3)
    spam = [keywords(60), "\n".join(f"* [best desk lamp](http://shop.example/lamp-{i})" for i in range(20)), " ".join(f"#buy_desk_lamp{i}" for i in range(40)), "\n".join(f"http://deals.example/p?id={i}" for i in range(30)), PROSE[0] + "\n" + keywords(80), " ".join("Best desk lamp for cheap desk lamp users, get desk lamp free desk lamp at desk lamp shop." for _ in range(8))]
    fine = [prose, None, "", " ", "dependencies:\n" + "\n".join(f"  amber-{i}: ^1.{i}.0" for i in range(40)), "\n".join(f"2024-01-02T03:04:0{i % 10}Z INFO worker packs queue in {i} ms" for i in range(30)), prose + "\n" + keywords(10), "\n".join(f"- [notes {i}](http://docs.example/{i}): {PROSE[i % 4]}" for i in range(10)), "| a | b |\n" * 20, "- loadFile (function), line 3\n" * 30]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(fine + spam + spam[:1])] + [(0, prose, 0.1)], "doc_id bigint, text string, share double")
    assert {r.doc_id for r in W.found(df).collect()} == set(range(len(fine), len(fine) + len(spam) + 1))
    assert W.found(df.limit(0)).count() == 0


def laid(texts):
    return W.Pages(W.Lexer(), texts)


def prose_model(texts):
    pages = laid(texts)
    keys, piece = pages.trigrams()
    s = pages.cached()[pages.prose[pages.piece] & (pages.c >= W.CONTENT) & (pages.c < W.FUNCTION)]
    return W.Model(dict(Counter(keys[pages.prose[piece]].tolist())), (len(s), s.sum(), (s * s).sum()))


def test_perplexity_decides(monkeypatch):
    """A change list and pretended sentences differ by perplexity alone: without the model both are taken, or neither."""
    verbs, nouns = ["route", "merge", "split", "verify", "count", "load"], ["envelope", "lease", "symbol", "rank", "digest", "anchor"]
    changes = ["\n".join(f"- {R.choice(verbs)} {R.choice(nouns)} {R.choice(nouns)} and {R.choice(nouns)} {R.choice(nouns)}" for _ in range(8)) for _ in range(40)]
    spam = " ".join("Best desk lamp for cheap desk lamp users, get desk lamp free desk lamp at desk lamp shop." for _ in range(8))
    model = prose_model([" ".join(PROSE), *changes])
    pages = laid([changes[0], spam, " ".join(PROSE), ", ".join(f"{a} {b}" for a, b in zip(nouns, verbs)), None, ""])
    assert not W.other_kind(pages)[[0, 1]].any()
    got = W.spam_shares(pages, model) > 0.5
    assert got.tolist() == [False, True, False, True, False, False]
    run_on = laid([" and ".join("best desk lamp for cheap desk lamp" for _ in range(12)), " ".join(PROSE)])
    assert model.low(run_on)[0] > W.LOW > max(model.low(run_on)[1:])  # the page predicts itself
    monkeypatch.setattr(W.Model, "high", lambda self, p: W.np.full(p.units, 99.0))
    assert (W.spam_shares(pages, model) > 0.5).tolist()[:2] == [True, True]
    monkeypatch.setattr(W.Model, "high", lambda self, p: W.np.zeros(p.units))
    monkeypatch.setattr(W.Model, "low", lambda self, p: W.np.zeros(p.units))
    assert not (W.spam_shares(pages, model) > 0.5).any()


def test_slices_do_not_matter():
    """Layout in slices, a long text and repeated chunks give the shares of one layout."""
    texts = [keywords(30), " ".join(PROSE), None, "x " * 5000 + keywords(2000), "#a\n#b"]
    model = prose_model([" ".join(PROSE)] * 20)
    lexer = W.Lexer()
    assert [round(float(W.spam_shares(W.Pages(lexer, [t]), model)[0]), 9) for t in texts] == [round(float(x), 9) for x in W.spam_shares(laid(texts), model)]


def code(seed, n=12):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(8))
    return "\n".join(f"export function {word()}({word()}) {{\n  // why {word()} is not {word()}\n  const {word()} = {word()}.{word()}({r.randint(1, 999)});\n  return {word()};\n}}\n" for _ in range(n))


def test_files(spark):
    made = lambda i: "\n".join(f"export function encode{k:03d}(m) {{\n  writeField({k}, m.a_{k}, {(k * 7 + i) % 90});\n}}" for k in range(20))
    rows = [(i, "w", f"src/h{i}.ts", 50, 5, code(i) + "const T = [1, 2, 3, 4, 5, 6, 7];\n" * (i % 4 == 1)) for i in range(80)]
    rows += [(100 + i, "w", f"src/g{i}.ts", 50, 5, "// Code generated by x. DO NOT EDIT.\n" + made(i)) for i in range(25)]
    table_of = lambda i: "export const T = [\n" + "".join(f"0x{i}f, 0x2e, {k}, 4,\n" for k in range(40)) + "];\n"
    rows += [(200, "w", "src/quiet.ts", None, None, made(77))] + [(210 + i, "w", f"d{i}.ts", 9, 1, table_of(i)) for i in range(6)] + [(220, "v", "b.ts", 9, 1, '{\n"a": [1, 2, 3, 4, 5],\n "b": {"c": "d", "e": 6}\n}')]
    for i in range(8):  # copies with and without a notice, changed a little
        rows += [(300 + i, f"v{i}", "lib/x.ts", 9, 9, "// Vendored from lib 2.0\n" + f"// local patch {i}\n" * (i % 2) + code(500)), (310 + i, f"u{i}", "src/y.ts", 9, 9, f"// local patch {i}\n" * (i % 2) + code(500))]
    rows += [(320, "t", "src/z.ts", 9, 9, code(501) + "\n// Vendored from lib 2.0\n")]
    rows += [(400, "w", "src/h0.ts", 50, 5, code(0)), (401, "w", "n.ts", 1, 1, None), (402, "w", "e.ts", 0, 0, "\n"), (403, "w", "src/own.ts", 9, 9, code(502) + 'const BANNER = "// Code generated by x. DO NOT EDIT.";\n// not generated: edit this file freely, it is kept by hand\n'), (404, "w", "t.ts", 50, 5, code(503) + "const T = [1, 2, 3, 4, 5, 6, 7, 8];\n")]
    df = spark.createDataFrame(rows, "file_id bigint, workspace string, file string, lines int, symbols int, content string")
    got = {r.file_id: (r.kind, r.noticed) for r in H.judged(df).where("kind is not null").collect()}
    want = {100 + i: ("generated", True) for i in range(25)} | {200: ("generated", False), 220: ("data", False), 320: ("vendored", True)} | {210 + i: ("data", False) for i in range(6)}
    assert got == want | {300 + i: ("vendored", True) for i in range(8)} | {310 + i: ("vendored", False) for i in range(8)}
    assert H.found(df.limit(0)).count() == 0
    # without a notice of any kind there is nothing to learn from
    plain = df.where("file_id < 80 or file_id >= 400")
    assert H.found(plain).count() == 0


def test_hot_runs_are_counted(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i, [1, 2 + i]) for i in range(60)] + [(100, 1000, [1, 7, 900]), (101, 1000, [900, 901])], "file_id bigint, origin bigint, runs array<bigint>")
    for hot in (2, 8, 100_000):
        monkeypatch.setattr(H, "HOT", hot)
        got = {r.file_id: round(r.shared, 4) for r in H.shared_runs(rows).collect()}
        assert got == {i: 1.0 if i == 5 else 0.5 for i in range(60)} | {100: 0.6667}


def test_fit_is_exact_or_best():
    for k in range(200):
        r = random.Random(k)
        h = {r.randint(1, 40): r.randint(1, 9) for _ in range(r.randint(1, 6))}
        total, repeats = sum(n * c for n, c in h.items()), r.randint(1, 3)
        budget = r.randint(0, total * repeats + 5)
        passes, more = M.fit(h, budget, repeats, k)
        drawn = passes * total + sum(n * c for n, c in more.items())
        assert drawn <= budget and all(c <= h[n] for n, c in more.items()) and passes + bool(more) <= repeats
        sums = {0}
        for n, c in h.items():
            sums = {s + n * j for s in sums for j in range(c + 1)}
        rest = min(budget, total * repeats)
        best = max(p * total + s for p in range(repeats + 1) for s in sums if p * total + s <= rest and p + (s > 0) <= repeats)
        assert best - drawn <= max(h), (h, budget)


def test_mix(spark):
    docs = [(i, "Big " if i % 2 else "big", "word " * (5 + i % 17)) for i in range(300)] + [(1000 + i, "small", "some words here " * 3) for i in range(4)] + [(2000, None, "x"), (2001, "big", None), (2002, "other", "x y z"), (1000, "small", "some words here " * 3)]
    targets = spark.createDataFrame([("big", 0.6, 1), ("SMALL", 0.3, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    rows = M.mixed(df, targets).collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.repeats <= (3 if r.source == "small" else 1) for r in rows)
    s = {r.source: r for r in M.shares(df, targets).collect()}
    drawn = {k: sum(r.tokens * r.repeats for r in rows if r.source == k) for k in ("big", "small")}
    assert drawn == {k: s[k].drawn_tokens for k in drawn} and abs(drawn["big"] / drawn["small"] - 2) < 0.05
    assert s["none"].drawn_tokens == 0 and s["other"].target_share is None and sorted(M.mixed(df, targets).collect()) == sorted(rows)
    assert M.mixed(df.limit(0), targets).count() == 0 and M.mixed(df, targets.limit(0)).count() == 0


def test_lists_of_single_words(spark):
    words = "linter debugger formatter compiler bundler profiler tracer editor terminal shell parser scanner emulator container registry scheduler".split()
    spam = [", ".join(words), "\n".join(words), "\n".join("* " + w for w in words), "\n".join("#" + w for w in words), ", ".join(w + " tool" for w in words), ", ".join(f"{a} {b}" for a, b in zip(words, words[::-1]))]
    fine = ["\n".join(PROSE * 3), "Разбор начинается с чтения всего файла целиком\nзатем строятся узлы дерева для каждой строки\nошибки собираются отдельно и выводятся позже", "这是一个解析器\n" * 20, "\n".join(PROSE + words[:4]), "\n".join(f"{w}: what it does for the reader" for w in words), "\n".join(f"{w}({v})" for w, v in zip(words, words[1:]))]
    df = spark.createDataFrame(list(enumerate(fine + spam)), "doc_id bigint, text string")
    assert {r.doc_id for r in W.found(df).collect()} == set(range(len(fine), len(fine) + len(spam)))
