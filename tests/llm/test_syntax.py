import ast
import random

import pytest

from larkspur.llm import syntax
from larkspur.llm.grammars import language

VALID = {
    "typescript": [
        "", "// x\n", 'import a, { b as c, type D } from "./x.js";\nimport type { E } from "y";\nimport * as z from "z"\n', "export class A<T> extends B<T> implements I, J {\n  private readonly x?: Map<string, number[]> = new Map<string, number[]>();\n  constructor(private y: string, z = 1) { super(); }\n  static async *g<U>(this: A<U>, ...r: U[]): AsyncGenerator<U> { yield* r }\n  get v(): number { return this.x!.size }\n  abstract m?(): void;\n  [key: string]: unknown\n}\n",
        "export const f = async <T,>(x: T): Promise<T[]> => { return [x] };\nlet a = b ? c : d ? (e) => 1 : f;\n", "interface I extends J<K> { readonly a: string; b?(x: number): void, [k: string]: any; new (x: string): I }\ntype U = 'a' | { b: (x: number) => void } | typeof c[number];\nenum E { A = 1, B, 'c' }\n",
        "label: for (const [k, v] of Object.entries(o)) { if (k) continue label; else break }\nfor (let i = 0, n = 3; i < n; i++) ;\ntry { x() } catch { } finally { y() }\nswitch (q) { case 1: case 2: z(); break; default: w() }\ndo { a++ } while (a < 3)\n",
        "const r = s.replace(/[{(\\[]{1,3}/g, `a${b ? `c` : '}'}d`) as unknown as string;\nconst n = x / 2 / y;\ndeclare module 'm' { export function g(): void }\nexport default function () {}\n",
        "function o(a: string): void\nfunction o(a: any) {}\nabstract class Q { protected abstract z(): void }\nexport * as ns from './n'\nconst g = obj?.a?.[1]?.(2) ?? null!\n", "[1, 2, 3]\n", "a\nb\n(c)\n", "const x = { a, 'b': 1, [c]: 2, d() {}, async *e() {}, get f() { return 1 }, ...g }\n",
    ],
    "javascript": ["#!/usr/bin/env node\n'use strict'\nvar a = function* () { yield; }, b = class extends A { #p = 1; static { this.q = 2 } }\n", "module.exports = { a: 1 }\nif (a) b\nelse c\n", "const EXAMPLE = `\n<<<<<<< HEAD\n`;\n", "export default class { }\nimport('x').then(m => m.default)\nasync () => { for await (const x of y) await x }\n", "(function(){ return typeof void 0 })()\n!function(a,b){a.c=b||{d:1}}(e,0)\n"],
    "python": [],
    "go": ['package main\n\nimport (\n\t"fmt"\n\tx "a/b"\n)\n\ntype T[K comparable] struct {\n\tA, B int `json:"a"`\n\t*E\n}\n\ntype I interface {\n\tM(int, ...string) (n int, err error)\n\t~int | string\n}\n\nvar a, b = map[string][]int{"x": {1, 2}}, func() int { return 1 }()\n\nfunc (t *T[K]) M(x int, y ...string) (n int, err error) {\n\tif v, ok := m[x]; ok && v > 1 {\n\t\tgo f()\n\t} else if x == \'{\' {\n\t\tdefer g.h(T{A: 1}, &U{2}, []byte("q"))\n\t} else {\n\t\tx++\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor k, v := range m {\n\t\t_ = k\n\t}\n\tfor {\n\t\tbreak\n\t}\n\tswitch y := z.(type) {\n\tcase int, *T:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v := <-d:\n\t}\n\treturn\n}\n', "", "// only a comment\n", "package p\nconst (\n\tA = iota\n\tB\n)\n"],
    "rust": ["//! doc\n#![allow(x)]\nuse std::{fmt, io::{self, Read as R}};\npub(crate) struct A<'a, T: Clone + 'a = u8> where T: Send { pub b: &'a mut T, c: [u8; 4] }\nenum E { A, B(i32, String), C { x: u8 } = 3 }\nimpl<T> fmt::Display for A<'_, T> { fn fmt(&self, f: &mut fmt::Formatter<'_>) -> fmt::Result { write!(f, \"{}\", self.b) } }\ntrait Q { const N: usize; type O: Clone; fn m(self: Box<Self>) -> Self::O; }\n", "pub async fn f(mut a: Vec<Vec<u8>>, (b, _): (i32, char)) -> Result<Option<u8>, Box<dyn std::error::Error>> {\n    let x: u32 = if a.len() > 1 { 2 } else { 3 };\n    let c = |y: i32, &z| -> i32 { y + z };\n    for (i, v) in a.iter().enumerate() { match v { Some(n) if *n > 1 => n, 1..=5 | 7 => {} , _ => return Ok(None), } }\n    while let Some(q) = s.pop() { if let Ok(w) = q.parse::<u8>() { break 'outer } }\n    let S { p, .. } = S { p: 1, ..Default::default() };\n    vec![1; 3].into_iter().map(|k| k as u64 * 2)?;\n    let ch = '{'; let r = r#\"}\"#; unsafe { *p = 1 };\n    x..=y\n}\nmacro_rules! m { ($a:expr) => { $a } }\nstatic T: &[&str] = &[\"a\"];\n", ""],
}
INVALID = {
    "typescript": ["function f( {", "const x = ", "const a = 1 const b = 2", "<!DOCTYPE html>\n<html></html>", "import logging\nfrom a.b import c", "some prose about things", '{\n  "a": 1,\n  "b": 2\n}', "a\n<<<<<<< HEAD\nb\n=======\nc\n>>>>>>> x\n", "class A { m() { ", "return x\n}\n", "const s = 'abc\n", "/* open", "x = `abc ${d"],
    "javascript": ["interface I { a: string }", "function f(a: string) {}", "import type { A } from 'b';\n", "package main\n", "let x = 3 4", "pub fn x() {}"],
    "python": ["def f(:\n", "def f():\nx = 1\n", "  x = 1\n", "if x:\n", "print 'a'\n", "x = [1, 2\n", "class A:\n    def f(self):\n        return (", "a b\n", "s = 'abc\n", "x = 1\n  y = 2\n", "def f():\n        a\n    b\n", "try:\n    pass\n", "… 3 more lines"],
    "go": ["func main() {}\n", "package p\nfunc f( {\n}\n", "package p\nfunc f() {\n", "import logging\n", "package p\nx := 1\n", "package p\nfunc f() {\n\ta b\n}\n"],
    "rust": ["fn f( {}", "fn f() {", "let x = 1;", "fn f() { a b }", "package main", "struct A { x: }", "fn f() { let s = \"abc; }"],
}


@pytest.mark.parametrize("lang", VALID)
def test_valid(lang):
    for text in VALID[lang]:
        for made in (text, text.replace("\n", "\r\n")):
            assert syntax.verdict(lang, made)[0] == "valid", (made, syntax.verdict(lang, made))


@pytest.mark.parametrize("lang", INVALID)
def test_invalid(lang):
    for text in INVALID[lang]:
        assert syntax.verdict(lang, text)[0] in ("unexpected", "truncated"), text


def test_failing_token_and_truncation():
    assert syntax.verdict("typescript", "let a = 1;\nlet b = = 2;\n") == ("unexpected", 8, 2)
    assert syntax.verdict("python", "x = 1\ny = = 2\n") == ("unexpected", 6, 2)
    assert syntax.verdict("go", "package p\nfunc f() {\n")[0] == "truncated"
    assert syntax.verdict("rust", None) == syntax.verdict("rust", " \n") == ("valid", None, None)


def test_python_agrees_with_its_own_parser():
    source = open(ast.__file__).read()
    r = random.Random(4)
    chunks = [ast.get_source_segment(source, n) or "" for n in ast.parse(source).body]
    cases = ["\n".join(chunks)] + [x for x in chunks if x]
    cases += [x[: r.randrange(len(x))] for x in cases * 2] + [x.replace(*c) for x in cases[:40] for c in ((":", ""), ("(", ""), ("=", "= ="), (",", ""))]
    grammar = language("python")
    for text in cases:
        try:
            ast.parse(text)
            want = True
        except (SyntaxError, ValueError):
            want = False
        if want:
            assert grammar.check(text) == -1, text
        elif grammar.check(text) == -1:  # what only later stages than the grammar reject
            with pytest.raises(SyntaxError):
                ast.parse(text)


def test_deep_and_long_texts():
    assert syntax.verdict("typescript", "(" * 20_000 + "1" + ")" * 20_000)[0] == "valid"
    assert syntax.verdict("python", "x = 1\n" * 50_000)[0] == "valid"


def test_table(spark):
    rows = [(1, "w", "a.py", "x ="), (1, "w", "a.py", "x ="), (2, "w", "b.TS", None), (3, None, None, "x ="), (4, "w", "c.md", "x ="), (5, "v", "d.rs", "fn")]
    df = spark.createDataFrame(rows, "file_id bigint, workspace string, file string, content string").withColumn("language", __import__("pyspark").sql.functions.lit("clash"))
    assert {r.file_id for r in syntax.found(df).collect()} == {1, 5}
    assert {(r.workspace, r.language, r.files, r.invalid, r.rate) for r in syntax.rates(df).collect()} == {("w", "python", 2, 2, 1.0), ("w", "typescript", 1, 0, 0.0), ("v", "rust", 1, 1, 1.0)}
    assert syntax.found(df.limit(0)).count() == 0
