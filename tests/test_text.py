from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import extract, fuzzy


def test_locate_strategies():
    find = lambda t, o, h=None: (fuzzy.locate(t, o, h) or ("none",))[0]
    assert find("a\nb\nc", "b") == "exact"
    assert find("  a\n  b\n", "a\nb") == "trimmed"
    assert find("if x:\n  foo(alpha, beta)\nend of it\n", "if x:\n  foo(alpha, betas)\nend of it") == "anchored"
    assert find("a  =   1\nb", "a = 1") == "whitespace"
    assert find('say("x")\n', "say(“x”)") == "typography"
    assert find("p('a\nb')\n", "p('a\\nb')") == "escapes"
    assert find("x\ny\nx\n", "x") == "none" and find("x\ny\ny\ny\ny\ny\ny\nx\n", "x", 8) == "exact" and find("x\nx", "x", 99) == "none"
    assert find("abc", "") == "none" and find("", "x") == "none"


def test_edits_apply_in_turn(spark):
    rows = spark.createDataFrame([(1, "a b", [("a", "c", None), ("c b", "d", None), ("zz", "q", None)]), (2, None, [("a", "b", 1)]), (3, "k", None)], "id int, content string, edits array<struct<old_text: string, new_text: string, line_hint: int>>")
    got = {r.id: (r.result, r.strategies) for r in fuzzy.apply_edits(rows).collect()}
    assert got == {1: ("d", ["exact", "exact", "none"]), 2: (None, []), 3: ("k", [])}
    e = spark.createDataFrame([("f", 0, 1, "X"), ("f", 2, 3, "YY")], "file string, start int, end int, text string")
    assert fuzzy.apply_positions(spark.createDataFrame([("f", "abc"), ("g", "q")], "file string, content string"), e).orderBy("file").select("result").collect() == [("XbYY",), ("q",)]


def test_near_names_against_all_pairs(spark):
    import random

    r = random.Random(1)
    names = [(i, r.choice("xy"), "".join(r.choice("ab") for _ in range(r.randint(0, 7)))) for i in range(60)]
    def dist(a, b):
        return fuzzy.distance(a, b, 99)
    got = {(x.a, x.b, x.distance) for x in fuzzy.near_names(spark.createDataFrame(names, "id int, g string, name string"), "g", "name", "id", 2).collect()}
    assert got == {(i, j, dist(a, b)) for i, g, a in names for j, h, b in names if i < j and g == h and dist(a, b) <= 2}


def test_text_expressions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.strip_indent(F.lit("    a\n      b\n\n    c"))) == "a\n  b\n\nc"
    assert one(text.trim_lines(F.lit(" a \n b"))) == "a\nb"
    assert one(text.plain_signs(F.lit("“a” – b…"))) == '"a" - b...'
    assert one(text.first_lines(F.lit("1\n2\n3\n4"))) == "1\n2\n3\n..." and one(text.first_lines(F.lit("1\n2\n3"))) == "1\n2\n3"
    assert one(text.slug(F.lit("--Hello, World! " + "x" * 60))).startswith("hello-world-x") and len(one(text.slug(F.lit("a b " * 40)))) <= 40
    assert one(text.bytes_text(F.lit(2048))) == "2.0 KB" and one(text.token_estimate(F.lit(9))) == 3


def test_extraction(spark):
    names = lambda lang, src: [(s[0], s[1]) for s in extract.symbols_of(lang, src)]
    assert names("python", "class A:\n    def f(self):\n        pass\n\nX = 1\nasync def g(): ...\n") == [("A", "class"), ("A.f", "method"), ("X", "variable"), ("g", "function")]
    assert names("python", "def broken(:\n    pass\nclass B(\n") == [("broken", "function"), ("B", "class")]
    assert names("typescript", "export interface I {\n}\nexport const f = async (x: number) => {\n}\nclass C {\n  m(a: string): void {\n  }\n}\n") == [("I", "interface"), ("f", "function"), ("C", "class"), ("C.m", "method")]
    assert names("go", "func (r *T) M() {\n}\nfunc F() {\n}\n") == [("T.M", "method"), ("F", "function")]
    assert names("rust", "impl T {\n    pub fn m(&self) {\n    }\n}\n") == [("T.m", "method")] and names("cobol", "x") == []
    assert [i[:2] for i in extract.imports_of("typescript", 'import { a as b } from "./x";\nconst q = require("y");')] == [("./x", "b"), ("y", "q")]
    assert [i[0] for i in extract.imports_of("go", 'import (\n "fmt"\n x "a/b"\n)\n')] == ["fmt", "a/b"]
    assert extract.refs_of("let x: Foo = new Bar<Baz>(); // : Nope") == ["Bar", "Baz", "Foo"]
    files = spark.createDataFrame([("a.ts", None), ("b.md", "x"), ("c.py", "def f(): pass")], "file string, content string")
    assert [r.name for r in extract.symbols(files).collect()] == ["f"] and [r.name for r in extract.exports(files).collect()] == ["f"]
    found = spark.createDataFrame([("w", "src/a.ts", "./b.js", 1, True), ("w", "src/a.ts", "zod", 2, False)], "ws string, file string, source string, line int, is_relative boolean")
    known = spark.createDataFrame([("w", "src/b.ts")], "ws string, path string")
    assert [r.resolved for r in extract.resolve_imports(found, known, ["ws"]).collect()] == ["src/b.ts"]


def test_docs_and_signatures():
    at = lambda lang, src: {r[0]: (r[4], r[6]) for r in extract.symbols_of(lang, src)}
    ts = "/**\n * Loads it.\n * @param a x\n */\n\n@dec()\nexport function load(\n  a: string,\n): void {\n}\n// one\n// two\nconst f = (x) => x;\nlet y;\nexport class A {\n}\n"
    assert at("typescript", ts) == {"load": ("export function load( a: string, ): void", "Loads it. @param a x"), "f": ("const f = (x) => x;", "one two"), "A": ("export class A", None)}
    py = "# above\ndef f(\n    a,\n    b=1,\n):\n    return a\n\ndef g():\n    \"\"\"Says\n    more.\"\"\"\n"
    assert at("python", py) == {"f": ("def f( a, b=1, )", "above"), "g": ("def g()", "Says more.")}
    assert at("rust", "/// Adds.\n#[inline]\npub fn add(a: u8) -> u8 {\n a\n}\n")["add"] == ("pub fn add(a: u8) -> u8", "Adds.")
    assert at("go", "x := 1\n\nfunc F() {\n}\n")["F"] == ("func F()", None)


def test_key_columns_go_along(spark):
    files = spark.createDataFrame([("v", 1, "a.ts", "export function f() {\n}\n"), ("w", None, "a.ts", "export function f() {\n}\n")], "workspace string, file_id bigint, file string, content string")
    assert {(r.workspace, r.file_id, r.name) for r in extract.symbols(files, ("workspace", "file_id")).collect()} == {("v", 1, "f"), ("w", None, "f")}


def test_aliases_and_modules(spark):
    imports = "w string, file string, source string, line int, is_relative boolean"
    found = spark.createDataFrame([("w", "x/a.ts", "@app/util/b", 1, False), ("w", "x/a.ts", "exact", 2, False), ("w", "x/a.ts", "lib/c", 3, False), ("w", "x/a.ts", "@app/none", 4, False), ("v", "x/a.ts", "@app/util/b", 1, False), ("w", "p.py", "a.b", 1, False), ("w", "p.py", "pkg", 2, False), ("w", "p.py", "os", 3, False)], imports)
    aliases = spark.createDataFrame([("w", 0, "@app/*", ["gone/*", "src/*"], "."), ("w", 1, "exact", ["src/exact.ts"], "."), ("w", 2, "@app/util/*", ["other/*"], ".")], "w string, ordinal int, pattern string, targets array<string>, base string")
    known = spark.createDataFrame([("w", "src/util/b.ts"), ("w", "other/b.ts"), ("w", "src/exact.ts"), ("w", "lib/c/index.ts"), ("w", "src/a/b.py"), ("w", "pkg/__init__.py")], "w string, path string")
    assert {(r.source, r.resolved) for r in extract.resolve_aliases(found.where("file like '%.ts'"), aliases, known, ["w"]).collect()} == {("@app/util/b", "src/util/b.ts"), ("exact", "src/exact.ts"), ("lib/c", "lib/c/index.ts")}
    assert {(r.source, r.resolved) for r in extract.resolve_modules(found, known, ["w"]).collect()} == {("a.b", "src/a/b.py"), ("pkg", "pkg/__init__.py")}


def test_drift_lookup(spark):
    from larkspur.operators import search

    text = ["import { run } from 'x'", "", "run()", "", "export function run() {", "}", "const gone = 1"] + [""] * 40 + ["class Far {"]
    lines = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(text)], "file_id bigint, line_no int, line string")
    asked = spark.createDataFrame([(1, 1, "run", 5), (2, 1, "run", 2), (3, 1, "Far", 4), (4, 1, "x", 9), (5, 1, "nowhere", 1)], "symbol_id bigint, file_id bigint, name string, start_line int")
    assert {(r.symbol_id, r.line_no, r.tier) for r in search.drift_lookup(asked, lines, ["file_id"], "symbol_id").collect()} == {(1, 5, 0), (2, 5, 1), (3, 48, 2), (4, 1, 3)}


def test_near_names_with_repeated_names(spark, monkeypatch):
    import random

    r = random.Random(2)
    monkeypatch.setattr(fuzzy, "BLOCK", 4)
    names = [(i, r.choice(["x", "y", None]), r.choice(["red rod", "red rot", "old gear", "", "ab", None])) for i in range(80)]
    names += [names[3], (3, names[3][1], "red rod"), (None, "x", "ab")]
    df = spark.createDataFrame(names, "id int, g string, name string")
    want = sorted((g, i, j, fuzzy.distance(a, b, 99)) for i, g, a in names for j, h, b in names if None not in (i, j, g, a, b) and g == h and i < j and fuzzy.distance(a, b, 99) <= 3)
    assert sorted(tuple(x) for x in fuzzy.near_names(df, "g", "name", "id", 3).collect()) == want


def test_near_names_compares_each_name_once(spark):
    same = spark.range(3000).selectExpr("id", "'x' as g", "concat('red rod ', id % 3) as name")
    got = fuzzy.near_names(same, "g", "name", "id", 3)
    assert got.groupBy("distance").count().orderBy("distance").collect() == [(0, 3 * 1000 * 999 // 2), (1, 3 * 1000 * 1000)]
    assert fuzzy._near(same.select("g", F.col("name").alias("_name")).distinct(), "g", 3).count() == 6


def test_trigram_embedding_is_worked_out_once(spark):
    import math
    import zlib

    from larkspur.functions.vectors import trigram_embedding

    def want(x):
        counts = [0.0] * 16
        low = None if x is None else f" {x.lower()} "
        for i in range(max(len(low) - 2, 1) if low else 0):
            counts[zlib.crc32(low[i:i + 3].encode()) % 16] += 1
        n = math.sqrt(sum(c * c for c in counts))
        return [c / n for c in counts] if n else counts

    texts = [None, "", "a", "Red Rod", "Größe über alles", "ab" * 500]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, t string").select("id", trigram_embedding(F.col("t"), 16).alias("e"))
    assert [r.e for r in df.orderBy("id").collect()] == [want(x) for x in texts]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("crc32") == 1
