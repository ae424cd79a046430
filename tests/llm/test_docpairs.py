from larkspur.llm import docpairs as D


def names(lang, text):
    return [p[0] for p in D.pairs(lang, text)]


def test_javascript():
    assert names("typescript", "/** Adds two numbers quickly. */\n// prettier-ignore\nexport async function add(a: Map<string, {b: number}>, c = f(')')): Promise<void> {\n}\n") == ["add"]
    assert names("typescript", "// Reads what the cache holds.\n\nconst read = async (x: string): Promise<number> => {\n};\n") == ["read"]
    assert names("javascript", "// Upper bound of entries\nconst LIMIT = 3;\n\nfunction f() {\n}\n") == []
    assert names("typescript", "/** Doc of the class. */\nexport class A {\n  m() {\n    // looks like { a doc\n    if (x) {\n    }\n  }\n  /**\n   * Sends all of it.\n   * @param {string} x\n   */\n  @dec({ a: 1 })\n  async send(x: string) {\n    return `}`;\n  }\n}\n") == ["send"]
    assert names("javascript", "const s = `\n// fake doc here\nfunction g() {}\n`;\n// Real words about it\nfunction h() {}\n") == ["h"]
    assert names("javascript", "function out() {\n  // Helper that folds rows\n  function inner() {\n  }\n}\n") == ["inner"]
    assert names("javascript", "// Says something useful\nfoo(x);\n") == []


def test_other_languages():
    assert names("go", "// Close flushes the buffer and stops.\n//nolint:errcheck\nfunc (c *Conn) Close() error {\n}\n\n// Holds state of it\ntype T struct {\n}\n\nfunc bare() {}\n") == ["Close"]
    assert names("rust", "/// Counts open files.\n#[must_use]\npub(crate) fn count<'a>(x: &'a str) -> usize where T: X {\n    '{'\n}\n\nimpl T {\n    // ----- helpers -----\n    fn plain() {}\n}\n") == ["count"]
    py = 'class A:\n    """Doc of class."""\n\n    def __init__(self):\n        self.x = 1\n\n    @retry(times=3)\n    async def load(self, a, b=")") -> dict[str, int]:\n        r"""Loads rows from disk.\n\n        :param a:\n        """\n        return 1\n\n# Splits by weight\n@x\ndef split(a):\n    pass\n\n# Negates it fast\nneg = lambda x: -x\n'
    assert names("python", py) == ["load", "split", "neg"]
    assert names("python", 'X = """\n# not a doc of it\ndef f(): pass\n"""\n') == []


def test_what_has_no_content():
    for line in ["", "...", "TODO", "TODO: document", "FIXME write docs", "XXX", "tbd", "_summary_", "[no description]", "Description goes here.", "Add description", "The merge ledger method", "mergeLedger function.", "Merge ledger.", "merge_ledger", "@param x", "@returns", ":param x:", ":returns:", "@param {string} x", "@ts-ignore", "eslint-disable-next-line no-console", "pylint: disable=x", "noqa: E501", "go:noinline", "fmt: off", "====", "--- helpers ---", "utils", "x = f(y, 1);", "a = pack_b(c, 2)", "Copyright the x contributors. All rights reserved.", "SPDX-License-Identifier: MIT", "Licensed under the terms found in the LICENCE file.", "Use of this source is governed by the project licence.", "clippy: allow", "rustfmt-skip", "istanbul ignore next", "type: ignore"]:
        assert D.content([line], "mergeLedger") == [], line
    assert D.content(["=====", "private api", "====="], "f") == []


def test_what_has():
    for line in ["Returns the rows.", "@param x the row to read", ":param x: the row", "@returns the summary", "cache - noisy session at start-up", "Der Parser schreibt die Signatur.", "解析配置文件", "Call `x(y)` before the lock is released.", "Merge ledger only once a day.", "TODO: handle the empty ledger before merging"]:
        assert D.content([line], "mergeLedger") == [line], line


def test_table(spark):
    rows = [(1, "a.py", "# Reads it all\ndef f(): pass"), (1, "a.py", "# Reads it all\ndef f(): pass"), (2, None, "# x y\ndef f(): pass"), (3, "b.ts", None), (4, "c.ts", ""), (5, "d.ts", "// Sends rows away\nfunction g(a, b) {\n  if (x) {")]
    df = spark.createDataFrame(rows, "symbol_id bigint, file string, snippet string")
    assert {tuple(r) for r in D.found(df).collect()} == {(1, "f"), (5, "g")} and D.found(df.limit(0)).count() == 0


def test_functions_in_bodies():
    assert names("go", "func f() {\n\t// Tries it again after a pause.\n\tretry := func(n int) error {\n\t\treturn nil\n\t}\n}\n") == ["retry"]
    assert names("javascript", "function make() {\n  return {\n    // Sends rows away\n    send(x) {\n    },\n  };\n}\n") == ["send"]
    assert names("typescript", "function make() {\n  return class {\n    /** Reads what is held. */\n    async load(x: string): Promise<void> {\n    }\n  };\n}\n") == ["load"]
    assert names("rust", 'fn f() {\n    /// Counts open files.\n    #[cfg(feature = "x")]\n    fn count() {\n    }\n}\n') == ["count"]
    assert names("javascript", "function f() {\n  // Only when it is late\n  if (x) {\n  }\n}\n") == []


def codes(lang, text):
    return [(p[0], p[3]) for p in D.pairs(lang, text)]


def test_whole_bodies():
    f = 'def f(x):\n    """Reads rows from it."""\n    a = [\n1]\n\n    # odd indent\n  # of this\n    if x:\n        s = """\nno end"""\n    return a\n'
    assert codes("python", f + "\n# Splits by weight\ndef g(x): return (x,\n  1)\n\n# Negates it fast\nneg = lambda x: {\n  x: 1}\ny = 2\n") == [
        ("f", f[:-1]), ("g", "# Splits by weight\ndef g(x): return (x,\n  1)"), ("neg", "# Negates it fast\nneg = lambda x: {\n  x: 1}"),
    ]
    inner = "    # Counts open files\n    def g():\n        return 1"
    assert codes("python", 'def f():\n    """Reads rows from it."""\n' + inner + "\n    return g\nx = 1\n") == [("f", 'def f():\n    """Reads rows from it."""\n' + inner + "\n    return g"), ("g", inner)]
    assert codes("typescript", "// Sends rows away\nconst f = x => g(x, `)`)\n  .then(y => y);\nh();\n") == [("f", "g(x, `)`)\n  .then(y => y)")]
    assert codes("typescript", "// Sends rows away\nconst f: (a: number) => void = (a) => {\n  x();\n};\n") == [("f", "{\n  x();\n}")]
    assert codes("go", "// Do sends rows away.\nfunc Do() (\n\tmap[string]interface{},\n\terror,\n) {\n\tx()\n}\n") == [("Do", "{\n\tx()\n}")]
    assert codes("go", "// Do sends rows away.\nfunc Do() map[string]interface{} {\n\tx()\n}\n") == [("Do", "{\n\tx()\n}")]
    assert codes("rust", "/// Counts open files.\nfn a() -> [u8; 4] { b() }\n") == [("a", "{ b() }")]
    assert codes("rust", "// Counts open files\nlet f = |x: u8| x + 1;\n// Counts all of them\nlet g = move |x: u8| -> u8 { x };\n") == [("f", "x + 1"), ("g", "{ x }")]


def test_more_heads():
    assert names("typescript", "// Sends rows away\nconst f = (a: string): Promise<{ b: number }> => {\n};\n// Reads rows again\nexport function g<T extends { a: { b: T } }>(a: T): { b: { c: T } } {\n}\n") == ["f", "g"]
    assert names("typescript", "class A { /** Adds all rows. */ add() {} /** Drops old rows. */ drop() {} }\nx = 1; /* sets it at once */\nfunction f() {}\n") == ["add", "drop"]
    assert names("typescript", "/** Reads one or all. */\nfunction f(a: string): void;\nfunction f(a) {}\ninterface A {\n  /** Sends rows away. */\n  send(x: string): { a: 1 };\n}\n// Flushes the cache\nflush(x);\n") == ["f", "send"]
    assert names("javascript", "// Sends rows away\nfunction f(a) // and back\n{\n}\n") == ["f"]
    assert names("python", "# Reads rows from it\n@dec[0].x\ndef f(x): return x\n") == ["f"]
    assert names("go", "// Map maps all of them.\nfunc Map[T any, U []int](x []T) U {\n}\n") == ["Map"]
