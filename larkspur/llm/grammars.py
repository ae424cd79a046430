"""Token grammars of TypeScript, JavaScript, Python 3, Go and Rust for the derivative parser.

Right parts are regular; all recursion goes through brackets (in Python also through INDENT and DEDENT).
Where a language nests without brackets (else-if chains, arrow bodies, prefix types) a loop stands for the
right recursion. Type arguments in angle brackets are token runs. The grammars accept a little more than
the languages and are meant to accept all of what is valid.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Callable

from . import jsx
from .derive import Machine

CACHE_LIMIT = 200_000


class Classes(dict):
    """Token text to class; texts not seen before are classified once."""

    def __init__(self, fixed: dict[str, int], classify: Callable[[str], int]):
        super().__init__(fixed)
        self.fixed, self.classify = fixed, classify

    def __missing__(self, text: str) -> int:
        if len(self) > CACHE_LIMIT:
            self.clear()
            self.update(self.fixed)
        got = self.classify(text)
        if len(text) < 80:
            self[text] = got
        return got


class Language:
    #: what is done to a text before it is read
    prepare = None

    def __init__(self, name: str, pattern: str, machine: Machine, fixed: dict[str, int], classify, layout=None):
        self.name, self.machine, self.layout = name, machine, layout
        self.lex = re.compile(pattern)
        self.find = self.lex.findall
        self.classes = Classes(fixed, classify)
        ix = machine.index
        self.start, self.skip, self.brk = machine.start("File"), ix["skip"], ix.get("nl", ix["skip"])

    def tokens(self, text: str) -> list[int]:
        found = self.find(text)
        return self.layout(found, self) if self.layout else list(map(self.classes.__getitem__, found))

    def check(self, text: str) -> int:
        """-1: valid, -2: ends too early, else index of the failing token."""
        return self.machine.run(self.tokens(text), self.start, self.skip, self.brk)

    def ordinal(self, text: str, index: int) -> int:
        """The failing token's place among the tokens that mean something, from 0."""
        return sum(t != self.skip and t != self.brk for t in self.tokens(text)[:index])

    def offset(self, text: str, index: int) -> int:
        """Character offset of a token."""
        if self.layout:
            return self.layout(self.lex.finditer(text), self, index)
        for i, m in enumerate(self.lex.finditer(text)):
            if i == index:
                return m.start(1) if m.group(1) is not None else m.start()
        return len(text)


_STRING = r'"(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"'
_STRING1 = r"'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'"
_NUM = r"(?:0[xXoObB][\da-fA-F_]+|(?:\d[\d_]*(?:\.(?!\.)[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)"

# JavaScript and TypeScript ---------------------------------------------------------------------------

_JS_RESERVED = "break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false".split()
_JS_SOFT = "let async await yield of get set static type interface declare abstract readonly public private protected override accessor implements namespace module as is from keyof infer unique satisfies asserts global".split()
_JS_PUNCT = {
    "binop": "== != === !== <= >= && || ?? << >> >>> ^ / %".split(), "assign": "+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split(),
    "pm": ["+", "-"], "incdec": ["++", "--"], "not": ["!", "~"],
}
_JS_SINGLE = "( ) [ ] { } ; , . ... => ? ?. : = < > * ** | & # @".split()


def _javascript(ts: bool) -> Language:
    names = ["skip", "nl", "bad", "id", "num", "str", "tmpl", "regex", "priv", *_JS_PUNCT, *_JS_SINGLE, *_JS_RESERVED, *_JS_SOFT]
    m = Machine(names, ["(", "[", "{"], [")", "]", "}"], semi=";")
    a, t, g, b = m.arena, m.t, m.g, m.bodies
    cat, alt, opt, star, plus, sep = a.cat, a.alt, a.opt, a.star, a.plus, a.seplist
    soft = "id " + " ".join(_JS_SOFT)
    ids, comma = t(soft), t(",")
    any_name = t(soft, " ".join(_JS_RESERVED))
    # types: prefix operators and atoms joined by operators
    angle_body = alt(t("id str num tmpl . , | & < > => ? : = pm this void null true false typeof in extends const new super import ...", " ".join(_JS_SOFT)), t("binop"), g("[", "TypeSoup", "]"), g("(", "TypeSoup", ")"), g("{", "TypeSoup", "}"))
    angles = cat(t("<"), star(angle_body), alt(t(">"), t("binop")))
    b["TypeSoup"] = star(alt(angle_body, t("; not default incdec")))
    type_args = opt(angles)
    prefix = t("keyof readonly unique infer typeof pm asserts abstract new")
    atom = alt(cat(t(soft, "this void null true false"), star(t("."), any_name), type_args), t("str num tmpl"), cat(t("import"), g("(", "Args", ")"), star(t("."), any_name), type_args), g("{", "TypeMembers", "}"), g("[", "TypeSoup", "]"), cat(opt(angles), g("(", "TypeSoup", ")"), opt(t("=>"))))
    arrow_atom = cat(opt(angles), g("(", "TypeSoup", ")"), t("=>"))
    unit = cat(star(alt(prefix, arrow_atom)), atom, star(g("[", "TypeSoup", "]")), opt(t("is"), ids, star(g("[", "TypeSoup", "]"))))
    joined = cat(opt(t("| &")), unit, star(t("| & extends is"), unit))
    type_ = cat(joined, star(t("?"), joined, t(":"), joined)) if ts else 0
    annotation = opt(t(":"), type_) if ts else 1
    generics = type_args if ts else 1
    # expressions
    fn_tail = cat(generics, g("(", "Params", ")"), annotation, g("{", "Stmts", "}"))
    function = cat(opt(t("async")), t("function"), opt(t("*")), opt(ids), fn_tail)
    heritage = cat(opt(t("extends"), plus(alt(any_name, t("."), g("(", "Args", ")"), g("[", "Index", "]"), angles if ts else 0))), opt(t("implements"), joined, star(comma, joined)) if ts else 1)
    class_ = cat(t("class"), opt(ids), generics, heritage, g("{", "Members", "}"))
    lit = alt(ids, t("this super null true false num str tmpl regex priv"), cat(t("import"), alt(g("(", "Args", ")"), cat(t("."), any_name))), cat(t("new"), t("."), ids))
    primary = alt(lit, g("(", "Expr", ")"), g("[", "Array", "]"), g("{", "Object", "}"), function, class_)
    calls = alt(g("(", "Args", ")"), t("tmpl"))
    post = star(alt(cat(t(". ?."), alt(any_name, t("priv"))), cat(opt(t("?.")), g("[", "Index", "]")), cat(opt(t("?.")), calls), cat(angles, calls) if ts else 0, t("not") if ts else 0, t("incdec"), cat(t("as satisfies"), alt(type_, t("const"))) if ts else 0))
    unary = t("pm not incdec typeof void delete await yield new")
    unary = alt(unary, cat(t("yield"), t("*")))
    ops = t("binop pm < > * ** | & in instanceof")

    def binary(first: int) -> int:
        operand = cat(star(unary), primary, post)
        return cat(alt(cat(first, post), cat(plus(unary), primary, post)), star(ops, operand))

    def assignment(first: int) -> int:
        arrow = cat(opt(t("async")), alt(ids, cat(generics, g("(", "Params", ")"), annotation)), t("=>"))
        lead = alt(arrow, cat(binary(primary), t("= assign")))
        block = cat(arrow, g("{", "Stmts", "}"))
        yields = t("yield")
        inner = alt(cat(star(lead), alt(binary(primary), block, yields)))
        again = cat(inner, star(t("?"), inner, star(t("?"), inner, t(":"), inner), t(":"), inner))
        if first == primary:
            return again
        start = alt(binary(first), block, yields, cat(alt(arrow, cat(binary(first), t("= assign"))), inner))
        return cat(start, star(t("?"), inner, star(t("?"), inner, t(":"), inner), t(":"), inner))

    assign = assignment(primary)
    expr = cat(assign, star(comma, assign))
    plain = alt(lit, g("(", "Expr", ")"), g("[", "Array", "]"))
    expr_stmt = cat(assignment(plain), star(comma, assign), t(";"))
    b["Expr"] = b["Index"] = expr
    b["Args"] = opt(sep(cat(opt(t("...")), assign), comma))
    b["Array"] = cat(star(comma), opt(cat(opt(t("...")), assign), star(plus(comma), opt(t("...")), assign), star(comma)))
    prop_name = alt(any_name, t("str num priv"), g("[", "Index", "]"))
    method = cat(star(t("async get set static")), opt(t("*")), prop_name, opt(t("?")) if ts else 1, fn_tail)
    b["Object"] = opt(sep(alt(cat(t("..."), assign), cat(prop_name, t(":"), assign), cat(ids, opt(t("="), assign)), method), comma))
    pattern = alt(ids, g("{", "Object", "}"), g("[", "Array", "]"))
    modifiers = star(t("public private protected readonly override")) if ts else 1
    decorator = cat(t("@"), alt(cat(ids, star(t("."), any_name), opt(g("(", "Args", ")"))), g("(", "Expr", ")")))
    param = cat(star(decorator), modifiers, opt(t("...")), alt(pattern, t("this") if ts else 0), opt(t("?")) if ts else 1, annotation, opt(t("="), assign))
    b["Params"] = opt(sep(param, comma))
    member_words = star(t("static async get set accessor" + (" readonly public private protected abstract override declare" if ts else "")))
    field = cat(opt(t("? not")) if ts else 1, annotation, opt(t("="), assign), t(";"))
    method_tail = cat(opt(t("?")) if ts else 1, generics, g("(", "Params", ")"), annotation, alt(g("{", "Stmts", "}"), t(";") if ts else 0))
    b["Members"] = star(alt(t(";"), decorator, cat(t("static"), g("{", "Stmts", "}")), cat(member_words, alt(cat(opt(t("*")), prop_name, method_tail), cat(prop_name, field)))))
    if ts:
        b["Members"] = a.star(alt(t(";"), decorator, cat(t("static"), g("{", "Stmts", "}")), cat(member_words, g("[", "TypeSoup", "]"), annotation, t(";")), cat(member_words, alt(cat(opt(t("*")), prop_name, method_tail), cat(prop_name, field)))))
    if ts:  # the last member needs no separator
        member = cat(star(t("readonly get set pm")), alt(prop_name, t("new")), opt(t("pm")), opt(t("?")), alt(cat(generics, g("(", "Params", ")"), annotation), annotation))
        mapped = cat(star(t("readonly pm")), g("[", "TypeSoup", "]"), opt(t("pm")), opt(t("?")), annotation)
        call = cat(generics, g("(", "Params", ")"), annotation)
        b["TypeMembers"] = cat(star(opt(alt(member, mapped, call)), t("; ,")), opt(alt(member, mapped, call)))
        b["Enum"] = opt(sep(cat(prop_name, opt(t("="), assign)), comma))
    # statements
    bind = cat(pattern, opt(t("not")) if ts else 1, annotation, opt(t("="), assign))
    var = cat(t("const let var"), bind, star(comma, bind), t(";"))
    function_decl = cat(opt(t("async")), t("function"), opt(t("*")), ids, generics, g("(", "Params", ")"), annotation, alt(g("{", "Stmts", "}"), t(";") if ts else 0))
    class_decl = cat(star(decorator), opt(t("abstract")) if ts else 1, t("class"), ids, generics, heritage, g("{", "Members", "}"))
    ts_decl = 0
    if ts:
        ts_decl = cat(star(t("declare")), alt(
            cat(t("interface"), ids, generics, opt(t("extends"), joined, star(comma, joined)), g("{", "TypeMembers", "}")),
            cat(t("type"), ids, generics, t("="), type_, t(";")),
            cat(opt(t("const")), t("enum"), ids, g("{", "Enum", "}")),
            cat(t("namespace module global"), opt(alt(t("str"), cat(ids, star(t("."), ids)))), g("{", "Module", "}")),
            var, function_decl, class_decl,
        ))
    declaration = alt(var, function_decl, class_decl, ts_decl)
    headed = alt(cat(t("if while with"), g("(", "Expr", ")")), cat(t("for"), opt(t("await")), g("(", "For", ")")), t("else do"), cat(ids, t(":")))
    catch = cat(t("catch"), opt(g("(", "Catch", ")")), g("{", "Stmts", "}"))
    b["Catch"] = cat(pattern, annotation)
    block = g("{", "Stmts", "}")
    tried = cat(t("try"), block, alt(cat(catch, opt(t("finally"), block)), cat(t("finally"), block)))
    jump = cat(alt(cat(t("return"), opt(expr)), cat(t("break continue"), opt(ids)), cat(t("throw"), expr), t("debugger")), t(";"))
    stmt = cat(star(headed), alt(block, t(";"), declaration, expr_stmt, jump, tried, cat(t("switch"), g("(", "Expr", ")"), g("{", "Cases", "}"))))
    b["Stmts"] = star(stmt)
    b["Cases"] = star(alt(cat(t("case"), expr), t("default")), t(":"), star(stmt))
    declared = cat(t("const let var"), pattern, annotation)
    simple = opt(alt(cat(t("const let var"), bind, star(comma, bind)), expr))
    b["For"] = alt(cat(simple, t(";"), opt(expr), t(";"), opt(expr)), cat(alt(declared, cat(primary, post)), t("of in"), expr))
    spec = cat(opt(t("type")) if ts else 1, alt(any_name, t("str")), opt(t("as"), alt(any_name, t("str"))))
    b["Specs"] = opt(sep(spec, comma))
    names_ = g("{", "Specs", "}")
    source = cat(t("from"), t("str"), opt(t("with"), g("{", "Object", "}")))
    star_as = cat(t("*"), t("as"), ids)
    clause = alt(ids, star_as, names_, cat(ids, comma, alt(star_as, names_)))
    imports = cat(t("import"), alt(t("str"), cat(opt(t("type")) if ts else 1, clause, source), cat(ids, t("="), expr) if ts else 0), t(";"))
    exports = cat(star(decorator), t("export"), alt(
        declaration, cat(t("default"), alt(cat(assignment(plain), t(";")), cat(g("{", "Object", "}"), post, t(";")), function, cat(opt(t("abstract")) if ts else 1, class_), ts_decl)),
        cat(opt(t("type")) if ts else 1, alt(cat(names_, opt(source)), cat(t("*"), opt(t("as"), alt(any_name, t("str"))), source)), t(";")),
        cat(t("="), expr, t(";")) if ts else 0, cat(t("import"), ids, t("="), expr, t(";")) if ts else 0,
    ))
    b["Module"] = b["File"] = star(alt(stmt, imports, exports))

    ix = m.index
    fixed = {"": ix["skip"], **{w: ix[w] for w in [*_JS_RESERVED, *_JS_SOFT, *_JS_SINGLE]}, **{p: ix[c] for c, ps in _JS_PUNCT.items() for p in ps}}

    def classify(x: str) -> int:
        c = x[0]
        if c in "\r\n  ":
            return ix["nl"]
        if c.isalpha() or c in "_$\\" or ord(c) > 127 and c.isidentifier():
            return ix["id"]
        if c.isdigit() or c == "." and x[1:2].isdigit():
            return ix["num"]
        if c in "\"'" and len(x) > 1:
            return ix["str"]
        if c == "`" and len(x) > 1:
            return ix["tmpl"]
        if c == "/" and len(x) > 1 and x[1] != "*":
            return ix["regex"]
        if c == "#" and len(x) > 1:
            return ix["priv"]
        return ix["bad"]

    hole = r"\$\{(?:[^{}`\"']|" + _STRING + "|" + _STRING1 + r"|`[^`]*`|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
    regex = r"/(?![*/])(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[a-z]*"
    pattern = (
        r"(?:[ \t\f\v ﻿]+|//[^\r\n  ]*|/\*[^*\r\n]*\*/|\A﻿?#![^\r\n]*)+|/\*(?:[^*]++|\*(?!/))*+\*/|"
        r"([A-Za-z_$][\w$]*|[\r\n]\s*|[()\[\]{};,]|" + _STRING + "|" + _STRING1 + "|" + _NUM + r"n?"
        r"|`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|" + hole + r")*`"
        r"|(?<=[(,=:\[!&|?{};+\n])" + regex + r"|(?<=[(,=:\[!&|?{};+] )" + regex + r"|(?<=return )" + regex +
        r"|=>|\.\.\.|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|={1,3}|!==?|\*\*=?|<<=?|>>>?=?|[<>]=|\+\+|--|[-+*/%&|^]=|/\*[\s\S]*+|#[A-Za-z_$][\w$]*|[^\W\d][\w$]*|\S)"
    )
    return Language("typescript" if ts else "javascript", pattern, m, fixed, classify)


# Go ---------------------------------------------------------------------------------------------------

_GO_KEYS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
_GO_PUNCT = {
    "binop": "== != <= >= && || << >> / % &^ > | ^".split(), "assign": "+= -= *= /= %= &= |= ^= <<= >>= &^=".split(), "pm": ["+", "-"], "incdec": ["++", "--"],
}
_GO_SINGLE = "( ) [ ] { } ; , . ... : = := <- < * & ! ~".split()


def _go() -> Language:
    names = ["skip", "bad", "id", "num", "str", *_GO_PUNCT, *_GO_SINGLE, *_GO_KEYS]
    m = Machine(names, ["(", "[", "{"], [")", "]", "}"])
    a, t, g, b = m.arena, m.t, m.g, m.bodies
    cat, alt, opt, star, plus, sep = a.cat, a.alt, a.opt, a.star, a.plus, a.seplist
    comma, semi, ident = t(","), t(";"), t("id")
    b["Len"] = opt(alt(t("..."), cat(t("binop pm ! * & id num str ."), star(t("binop pm ! * & < id num str .")))))
    wrap = alt(t("* <-"), g("[", "Len", "]"), cat(t("map"), g("[", "Types", "]")), cat(t("chan"), opt(t("<-"))))
    func_type = cat(t("func"), g("(", "Params", ")"))
    named = cat(ident, opt(t("."), ident), opt(g("[", "Types", "]")))
    base = alt(named, cat(t("struct"), g("{", "Fields", "}")), cat(t("interface"), g("{", "Methods", "}")), g("(", "Types", ")"), func_type)
    type_ = cat(star(alt(wrap, func_type)), base)
    result = opt(alt(type_, g("(", "Params", ")")))
    b["Types"] = opt(sep(type_, comma))
    b["Params"] = opt(sep(cat(opt(ident), opt(t("...")), type_), comma))
    b["TypeParams"] = sep(cat(ident, opt(opt(t("~")), type_, star(t("binop"), opt(t("~")), type_))), comma)
    field = cat(alt(cat(ident, star(comma, ident), type_), cat(opt(t("*")), named)), opt(t("str")))
    b["Fields"] = cat(star(opt(field), semi), opt(field))
    method = alt(cat(ident, g("(", "Params", ")"), result), cat(opt(t("~")), type_, star(t("binop"), opt(t("~")), type_)))
    b["Methods"] = cat(star(opt(method), semi), opt(method))
    block = g("{", "Block", "}")
    literal_type = alt(cat(plus(wrap), base), cat(t("struct"), g("{", "Fields", "}")))

    def expression(composite: bool) -> int:
        body = g("{", "Elements", "}")
        post = star(alt(cat(t("."), alt(ident, g("(", "Assert", ")"))), g("[", "Index", "]"), g("(", "Args", ")"), body if composite else 0))
        made = cat(alt(g("[", "Len", "]"), cat(t("map"), g("[", "Types", "]"))), star(wrap), base, alt(body, g("(", "Args", ")")))
        primary = alt(t("id num str"), g("(", "Expr", ")"), cat(func_type, result, block), made, cat(t("struct"), g("{", "Fields", "}"), body), cat(t("chan"), type_))
        operand = cat(star(t("pm ! * & <-")), primary, post)
        return cat(operand, star(t("binop pm < * &"), operand))

    expr, head = expression(True), expression(False)
    b["Expr"] = alt(expr, type_)
    b["Assert"] = alt(type_, t("type"))
    bound = opt(expr)
    b["Index"] = alt(sep(alt(expr, type_), comma), cat(bound, t(":"), bound, opt(t(":"), bound)))
    b["Args"] = opt(sep(cat(alt(expr, type_), opt(t("..."))), comma))
    value = alt(expr, g("{", "Elements", "}"))
    b["Elements"] = opt(sep(cat(value, opt(t(":"), value)), comma))

    def simple(e: int) -> int:
        many = cat(e, star(comma, e))
        return cat(many, opt(alt(cat(t("= := assign"), many), t("incdec"), cat(t("<-"), e))))

    many, many_head = cat(expr, star(comma, expr)), cat(head, star(comma, head))
    spec = cat(ident, star(comma, ident), opt(type_), opt(t("="), many))
    type_spec = cat(ident, opt(g("[", "TypeParams", "]")), opt(t("=")), type_)
    alias = cat(opt(alt(ident, t("."))), t("str"))
    b["Specs"], b["TypeSpecs"], b["Imports"] = (cat(star(opt(x), semi), opt(x)) for x in (spec, type_spec, alias))
    decl = alt(cat(t("var const"), alt(spec, g("(", "Specs", ")"))), cat(t("type"), alt(type_spec, g("(", "TypeSpecs", ")"))))
    s_head = simple(head)
    cond = cat(opt(opt(s_head), semi), head)
    ifs = cat(star(t("if"), cond, block, t("else")), alt(cat(t("if"), cond, block), block))
    if_stmt = cat(t("if"), cond, block, opt(t("else"), ifs))
    ranged = cat(opt(many_head, t("= :=")), t("range"), head)
    for_stmt = cat(t("for"), opt(alt(s_head, ranged, cat(opt(s_head), semi, opt(head), semi, opt(s_head)))), block)
    switch = cat(t("switch"), opt(opt(s_head), semi), opt(s_head), g("{", "Cases", "}"))
    select = cat(t("select"), g("{", "Cases", "}"))
    jump = alt(cat(t("return"), opt(many)), cat(t("break continue goto"), opt(ident)), t("fallthrough"), cat(t("go defer"), expr))
    stmt = cat(star(ident, t(":")), alt(decl, simple(expr), if_stmt, for_stmt, switch, select, jump, block, 1))
    b["Block"] = cat(star(opt(stmt), semi), opt(stmt))
    case = cat(alt(cat(t("case"), sep(alt(simple(expr), type_), comma, False)), t("default")), t(":"), b["Block"])
    b["Cases"] = star(case)
    func = cat(t("func"), opt(g("(", "Params", ")")), ident, opt(g("[", "TypeParams", "]")), g("(", "Params", ")"), result, opt(block))
    imports = cat(t("import"), alt(alias, g("(", "Imports", ")")))
    b["File"] = opt(star(semi), t("package"), ident, semi, star(imports, semi), star(alt(decl, func), semi))

    ix = m.index
    fixed = {"": ix["skip"], **{w: ix[w] for w in [*_GO_KEYS, *_GO_SINGLE]}, **{p: ix[c] for c, ps in _GO_PUNCT.items() for p in ps}}

    def classify(x: str) -> int:
        c = x[0]
        if c in "\r\n":
            return ix["skip"]
        if c == "_" or c.isalpha():
            return ix["id"]
        if c.isdigit() or c == "." and x[1:2].isdigit():
            return ix["num"]
        return ix["str"] if c in "\"'`" and len(x) > 1 else ix["bad"]

    ends = frozenset([ix[x] for x in "id num str incdec ) ] } return break continue fallthrough".split()])
    semi_id, skip = ix[";"], ix["skip"]

    def layout(found, lang: Language, want: int | None = None):
        """Tokens with the semicolons that line breaks stand for."""
        out, last, classes, n = [], skip, lang.classes, 0
        for x in found:
            text = x if want is None else x.group(1) or ""
            if text[:1] in ("\n", "\r") or text == "":
                if (text or (want is not None and "\n" in x.group())) and last in ends:
                    out.append(semi_id)
                    last = semi_id
            else:
                last = classes[text]
                out.append(last)
            if want is not None and len(out) > want:
                return x.start()
        if last in ends:
            out.append(semi_id)
        return out if want is None else -1

    pattern = (
        r"(?:[ \t\f\v﻿]+|/\*[^*\r\n]*\*/)+|//[^\r\n]*|/\*(?:[^*]++|\*(?!/))*+\*/|"
        r"([^\W\d]\w*|[\r\n]\s*|[()\[\]{};,]|" + _STRING + r"|`[^`]*`|'(?:[^'\\\r\n]|\\[^\r\n]+?)'|" + _NUM + r"i?"
        r"|\.\.\.|:=|<-|<<=?|>>=?|&\^=?|&&|\|\||\+\+|--|[-+*/%&|^=!<>]=|/\*[\s\S]*+|\S)"
    )
    return Language("go", pattern, m, fixed, classify, layout)


# Rust -------------------------------------------------------------------------------------------------

_RS_KEYS = "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while".split()
_RS_PUNCT = {"binop": "== != <= >= << / % ^".split(), "assign": "+= -= *= /= %= &= |= ^= <<= >>=".split()}
_RS_SINGLE = "( ) [ ] { } ; , . .. ..= ... : :: = => -> < > >> * & && ! ? | || + - # @ $ _ ~".split()


def _rust() -> Language:
    names = ["skip", "bad", "id", "num", "str", "life", *_RS_PUNCT, *_RS_SINGLE, *_RS_KEYS]
    m = Machine(names, ["(", "[", "{"], [")", "]", "}"])
    a, t, g, b = m.arena, m.t, m.g, m.bodies
    cat, alt, opt, star, plus, sep = a.cat, a.alt, a.opt, a.star, a.plus, a.seplist
    comma, semi = t(","), t(";")
    everything = t(*[n for n in names if n not in ("skip", "bad", "(", ")", "[", "]", "{", "}")])
    b["Soup"] = star(alt(everything, g("(", "Soup", ")"), g("[", "Soup", "]"), g("{", "Soup", "}")))
    groups = alt(g("(", "Soup", ")"), g("[", "Soup", "]"), g("{", "Soup", "}"))
    ident = t("id union")
    angle_item = alt(t("id union life num str , : :: = < > >> -> + & && * ! ? _ dyn impl fn for mut const self Self crate super true false - as extern unsafe where"), g("(", "Soup", ")"), g("[", "Soup", "]"), g("{", "Soup", "}"))
    angles = cat(t("<"), star(angle_item), t("> >>"))
    generics = opt(angles)
    segment = t("id union self Self super crate")
    path = cat(alt(cat(opt(t("::")), segment), cat(angles, t("::"), segment)), star(t("::"), alt(segment, angles)))
    type_path = cat(opt(t("::")), alt(segment, angles), star(alt(cat(t("::"), alt(segment, angles)), angles, cat(g("(", "Types", ")"), opt(t("->"))))))
    wrap = alt(cat(t("& &&"), opt(t("life")), opt(t("mut"))), cat(t("*"), t("const mut")), t("dyn impl ?"), cat(t("for"), angles), cat(star(t("unsafe")), opt(t("extern"), opt(t("str"))), t("fn"), g("(", "Types", ")"), t("->")))
    base = alt(type_path, g("[", "ArrayType", "]"), g("(", "Types", ")"), t("! _ life"), cat(star(t("unsafe")), opt(t("extern"), opt(t("str"))), t("fn"), g("(", "Types", ")")), cat(path, t("!"), groups))
    one = cat(star(wrap), base)
    returning = cat(path, g("(", "Types", ")"), t("->"))
    type_ = cat(star(returning), one, star(t("+"), one))
    b["Types"] = opt(sep(cat(opt(alt(ident, t("_")), t(":")), type_), comma))
    pattern_item = alt(t("id union num str life self Self super crate :: .. ..= ... | & && @ ref mut _ true false - const"), angles, g("(", "Pattern", ")"), g("[", "Pattern", "]"), g("{", "Pattern", "}"), cat(t("!"), groups))
    b["Pattern"] = star(alt(pattern_item, t(", : #")))
    pattern = plus(pattern_item)
    pattern_nobar = plus(alt(t("id union num str self Self super crate :: .. & && @ ref mut _ true false -"), angles, g("(", "Pattern", ")"), g("[", "Pattern", "]"), g("{", "Pattern", "}")))
    attr = cat(t("#"), opt(t("!")), g("[", "Soup", "]"))
    attrs = star(attr)
    block = g("{", "Block", "}")
    label = opt(t("life"), t(":"))

    def blocks(head: int) -> int:
        cond = alt(head, cat(t("let"), pattern, t("="), head))
        conds = cat(cond, star(t("&&"), t("let"), pattern, t("="), head))
        ifs = cat(t("if"), conds, block, star(t("else"), t("if"), conds, block), opt(t("else"), block))
        return alt(ifs, cat(label, alt(cat(t("while"), conds, block), cat(t("for"), pattern, t("in"), head, block), cat(t("loop"), block), block)), cat(t("match"), head, g("{", "Arms", "}")), cat(t("unsafe"), block), cat(t("async"), opt(t("move")), block), cat(t("const"), block))

    def expression(struct: bool, blocky: int) -> int:
        post = star(alt(cat(t("."), alt(cat(t("id union await self"), opt(t("::"), angles)), t("num"))), g("(", "Args", ")"), g("[", "Index", "]"), t("?"), cat(t("as"), one)))
        macro = cat(path, t("!"), groups)
        made = cat(path, g("{", "StructFields", "}")) if struct else 0
        primary = alt(t("num str true false"), path, made, macro, g("(", "Args", ")"), g("[", "ArrayExpr", "]"), blocky)
        closure = cat(star(t("async move static")), alt(cat(t("|"), opt(sep(cat(pattern_nobar, opt(t(":"), type_)), comma)), t("|")), t("||")), opt(t("->"), type_))
        lead = star(alt(t("- * !"), cat(t("& &&"), opt(t("mut"))), closure))
        jump = cat(t("return break continue"), opt(t("life")))
        operand = cat(star(jump), lead, alt(cat(primary, post), jump))
        ranged = t(".. ..=")
        ops = t("binop < > >> * & && | || + - = assign .. ..=")
        return alt(cat(opt(ranged), operand, star(ops, operand), opt(ranged)), ranged)

    # an expression without struct literals heads if, while, match and for; its own blocks are bodies again
    head = expression(False, cat(t("unsafe"), block))
    blocky = blocks(head)
    expr = expression(True, blocky)
    b["Args"] = opt(sep(cat(attrs, expr), comma))
    b["Index"] = expr
    b["ArrayExpr"] = opt(alt(cat(expr, semi, expr), sep(expr, comma)))
    b["ArrayType"] = cat(type_, opt(semi, expr))
    b["StructFields"] = cat(opt(sep(cat(attrs, alt(ident, t("num")), opt(t(":"), expr)), comma)), opt(t(".."), opt(expr)))
    arm_head = cat(attrs, opt(t("|")), pattern, opt(t("if"), expr), t("=>"))
    b["Arms"] = cat(star(alt(cat(arm_head, expr, comma), cat(arm_head, blocky, opt(comma)))), opt(arm_head, expr))
    # items
    bounds = opt(t(":"), star(alt(angle_item)))
    where = opt(t("where"), star(alt(t("id union life :: : + , ? < > >> = -> & && for dyn impl mut self Self crate super !"), g("(", "Soup", ")"), g("[", "Soup", "]"))))
    vis = opt(t("pub"), opt(g("(", "Soup", ")")))
    fn = cat(star(t("const async unsafe extern str")), t("fn"), ident, generics, g("(", "Params", ")"), opt(t("->"), type_), where, alt(block, semi))
    b["Params"] = opt(sep(cat(attrs, alt(cat(pattern, t(":"), alt(type_, t("..."))), cat(opt(t("&"), opt(t("life"))), opt(t("mut")), t("self"), opt(t(":"), type_)), t("..."))), comma))
    b["Fields"] = opt(sep(cat(attrs, vis, ident, t(":"), type_), comma))
    b["TupleFields"] = opt(sep(cat(attrs, vis, type_), comma))
    struct = cat(t("struct union"), ident, generics, alt(cat(where, g("{", "Fields", "}")), cat(g("(", "TupleFields", ")"), where, semi), cat(where, semi)))
    b["Variants"] = opt(sep(cat(attrs, vis, ident, opt(alt(g("{", "Fields", "}"), g("(", "TupleFields", ")"))), opt(t("="), expr)), comma))
    enum = cat(t("enum"), ident, generics, where, g("{", "Variants", "}"))
    impl = cat(opt(t("unsafe")), t("impl"), generics, opt(t("!")), type_, opt(t("for"), type_), where, g("{", "Items", "}"))
    trait = cat(opt(t("unsafe")), t("trait"), ident, generics, bounds, where, g("{", "Items", "}"))
    use = cat(t("use"), star(t(":: id union self super crate * as _")), opt(g("{", "UseTree", "}")), semi)
    b["UseTree"] = star(alt(t(":: id union self super crate * as _ ,"), g("{", "UseTree", "}")))
    const = cat(t("const static"), opt(t("mut")), alt(ident, t("_")), t(":"), type_, opt(t("="), expr), semi)
    alias = cat(t("type"), ident, generics, bounds, where, opt(t("="), type_), where, semi)
    mod = cat(opt(t("unsafe")), t("mod"), ident, alt(semi, g("{", "File", "}")))
    external = cat(opt(t("unsafe")), t("extern"), alt(cat(opt(t("str")), g("{", "Items", "}")), cat(t("crate"), t("id self"), opt(t("as"), alt(ident, t("_"))), semi)))
    rules = cat(path, t("!"), opt(ident), alt(g("{", "Soup", "}"), cat(alt(g("(", "Soup", ")"), g("[", "Soup", "]")), semi)))
    item = alt(fn, struct, enum, impl, trait, use, const, alias, mod, external)
    b["Items"] = star(alt(attr, cat(vis, alt(item, rules))))
    b["File"] = b["Items"]
    let = cat(t("let"), pattern, opt(t(":"), type_), opt(t("="), expr, opt(t("else"), block)), semi)
    b["Block"] = cat(star(alt(attr, semi, let, cat(vis, item), cat(expr, semi), cat(blocky), cat(path, t("!"), opt(ident), g("{", "Soup", "}")))), opt(expr))

    ix = m.index
    fixed = {"": ix["skip"], **{w: ix[w] for w in [*_RS_KEYS, *_RS_SINGLE]}, **{p: ix[c] for c, ps in _RS_PUNCT.items() for p in ps}}

    def classify(x: str) -> int:
        c = x[0]
        raw = re.match(r"[bc]?r(#*)\"", x)
        if raw:
            return ix["str"] if len(x) > raw.end() and x.endswith('"' + raw[1]) else ix["bad"]
        if c in "bc" and len(x) > 1 and x[-1] in "\"'#" or c in "\"'" and len(x) > 2 and x[-1] == c or x == '""':
            return ix["str"]
        if c == "'" and len(x) > 1:
            return ix["life"]
        if c == "_" or c.isalpha():
            return ix["id"]
        return ix["num"] if c.isdigit() else ix["bad"]

    pattern_ = (
        r"(?:\s+|//[^\r\n]*|\A﻿?#!(?!\[)[^\r\n]*)+|/\*(?:[^*/]++|\*(?!/)|/(?!\*)|/\*(?:[^*]++|\*(?!/))*+\*/)*+\*/|"
        r"(b?'(?:[^'\\\r\n]|\\(?:u\{[^}]*\}|x..|.))'|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|[bc]?r(#*)\"[\s\S]*?\"\2(?!#)|[bc]?r#*\"[\s\S]*+|r#[^\W\d]\w*|'[^\W\d]\w*|[^\W\d]\w*|[()\[\]{};,]"
        r"|\d[\d_]*\.(?![.\w])|(?:0[xob][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)\w*"
        r"|\.\.[.=]?|::|=>|->|<<=?|>>=|>>|&&|\|\||[-+*/%&|^=!<>]=|/\*[\s\S]*+|\S)"
    )
    lang = Language("rust", pattern_, m, fixed, classify)
    find = lang.lex.findall
    lang.find = lambda text: [x[0] for x in find(text)]
    return lang


# Python -----------------------------------------------------------------------------------------------

_PY_KEYS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
_PY_SOFT = ["match", "case", "type"]
_PY_PUNCT = {"binop": "== != < > <= >= << >> // / % | & ^ @".split(), "assign": "+= -= *= /= //= %= **= <<= >>= &= |= ^= @=".split(), "pm": ["+", "-"]}
_PY_SINGLE = "( ) [ ] { } ; , . ... : = := -> * ** ~".split()


def _python() -> Language:
    names = ["skip", "bad", "newline", "indent", "dedent", "id", "num", "str", *_PY_PUNCT, *_PY_SINGLE, *_PY_KEYS, *_PY_SOFT]
    m = Machine(names, ["(", "[", "{", "indent"], [")", "]", "}", "dedent"])
    a, t, g, b = m.arena, m.t, m.g, m.bodies
    cat, alt, opt, star, plus, sep = a.cat, a.alt, a.opt, a.star, a.plus, a.seplist
    comma, nl, ident, colon = t(","), t("newline"), t("id match case type"), t(":")
    calls = star(alt(cat(t("."), ident), g("(", "Args", ")"), g("[", "Index", "]")))
    primary = cat(alt(ident, t("num None True False ..."), plus(t("str")), g("(", "Tuple", ")"), g("[", "List", "]"), g("{", "Dict", "}")), calls)
    unary = t("pm ~ not await")
    ops = alt(t("binop"), t("pm * ** and or in is"), cat(t("is"), t("not")), cat(t("not"), t("in")))
    plain_arg = alt(cat(opt(t("* **")), ident), t("*"), cat(t("binop")))
    # lambda parameters have defaults without annotation
    operand0 = cat(star(unary), primary)
    chain0 = cat(operand0, star(ops, operand0))
    lam = cat(t("lambda"), opt(sep(cat(plain_arg, opt(t("="), chain0)), comma)), colon)
    operand = operand0
    chain = cat(operand, star(ops, operand))
    walrus = opt(ident, t(":="))
    cond = cat(star(lam), chain, star(t("if"), chain, t("else"), star(lam), chain))
    expr = cat(star(alt(lam, t("not"))), cond)
    named = cat(walrus, expr)
    starred = cat(opt(t("*")), named)
    many = sep(starred, comma)
    target = sep(cat(opt(t("*")), primary), comma)
    comp = plus(opt(t("async")), t("for"), target, t("in"), cond, star(t("if"), cat(walrus, star(lam), chain)))
    yields = cat(t("yield"), opt(alt(cat(t("from"), expr), many)))
    b["Tuple"] = opt(alt(yields, cat(starred, comp), many))
    b["List"] = opt(alt(cat(starred, comp), many))
    pair = alt(cat(expr, colon, expr), cat(t("**"), chain))
    b["Dict"] = opt(alt(sep(pair, comma), cat(pair, comp), cat(starred, comp), many))
    b["Args"] = opt(alt(cat(named, comp), sep(alt(cat(opt(t("* **")), named), cat(ident, t("="), expr)), comma)))
    bound = opt(expr)
    b["Index"] = sep(alt(starred, cat(bound, colon, bound, opt(colon, bound))), comma)
    param = alt(cat(opt(t("* **")), ident, opt(colon, opt(t("*")), expr), opt(t("="), expr)), t("*"), t("binop"))
    b["Params"] = opt(sep(param, comma))
    b["TypeParams"] = sep(cat(opt(t("* **")), ident, opt(colon, expr), opt(t("="), expr)), comma)
    value = alt(yields, many)
    dotted = cat(ident, star(t("."), ident))
    as_ = opt(t("as"), ident)
    b["Names"] = sep(cat(ident, as_), comma)
    from_ = cat(t("from"), alt(cat(star(t(". ...")), dotted), plus(t(". ..."))), t("import"), alt(t("*"), sep(cat(ident, as_), comma, False), g("(", "Names", ")")))
    simple = alt(
        cat(value, star(t("="), value)), cat(primary, colon, expr, opt(t("="), value)), cat(primary, t("assign"), value),
        cat(t("return"), opt(many)), cat(t("raise"), opt(expr, opt(t("from"), expr))), t("pass break continue"),
        cat(t("import"), sep(cat(dotted, as_), comma, False)), from_, cat(t("global nonlocal"), sep(ident, comma, False)),
        cat(t("del"), target), cat(t("assert"), expr, opt(comma, expr)), cat(t("type"), ident, opt(g("[", "TypeParams", "]")), t("="), expr),
    )
    line = cat(simple, star(t(";"), simple), opt(t(";")), nl)
    suite = cat(colon, alt(line, cat(nl, g("indent", "Suite", "dedent"))))
    b["WithItems"] = sep(cat(expr, opt(t("as"), opt(t("*")), primary)), comma)
    with_ = cat(t("with"), alt(sep(cat(expr, opt(t("as"), primary)), comma, False), g("(", "WithItems", ")")), suite)
    for_ = cat(t("for"), target, t("in"), many, suite, opt(t("else"), suite))
    def_ = cat(t("def"), ident, opt(g("[", "TypeParams", "]")), g("(", "Params", ")"), opt(t("->"), expr), suite)
    except_ = cat(t("except"), opt(t("*")), opt(expr, as_), suite)
    b["Cases"] = plus(cat(t("case"), star(alt(t("id match type num str None True False . , as * ** pm binop if not and or in is"), g("(", "Soup", ")"), g("[", "Soup", "]"), g("{", "Soup", "}"))), suite))
    b["Soup"] = star(alt(t(*[n for n in names if n not in ("skip", "bad", "newline", "indent", "dedent", "(", ")", "[", "]", "{", "}")]), g("(", "Soup", ")"), g("[", "Soup", "]"), g("{", "Soup", "}")))
    compound = alt(
        cat(t("if"), named, suite, star(t("elif"), named, suite), opt(t("else"), suite)), cat(t("while"), named, suite, opt(t("else"), suite)),
        for_, cat(t("try"), suite, alt(cat(plus(except_), opt(t("else"), suite), opt(t("finally"), suite)), cat(t("finally"), suite))), with_,
        cat(star(t("binop"), named, nl), alt(cat(opt(t("async")), def_), cat(t("class"), ident, opt(g("[", "TypeParams", "]")), opt(g("(", "Args", ")")), suite))),
        cat(t("async"), alt(for_, with_)), cat(t("match"), many, colon, nl, g("indent", "Cases", "dedent")),
    )
    stmt = alt(line, compound)
    b["File"], b["Suite"] = star(stmt), plus(stmt)

    ix = m.index
    fixed = {"": ix["skip"], **{w: ix[w] for w in [*_PY_KEYS, *_PY_SOFT, *_PY_SINGLE]}, **{p: ix[c] for c, ps in _PY_PUNCT.items() for p in ps}}

    def classify(x: str) -> int:
        c = x[0]
        if x[-1] in "\"'" and len(x) > 1:
            return ix["str"]
        if c == "_" or c.isalpha():
            return ix["id"] if x.isidentifier() else ix["bad"]
        return ix["num"] if c.isdigit() or c == "." and x[1:2].isdigit() else ix["bad"]

    newline, indent, dedent = ix["newline"], ix["indent"], ix["dedent"]
    openers, closers = {ix[x] for x in "([{"}, {ix[x] for x in ")]}"}

    def layout(found, lang: Language, want: int | None = None):
        """Tokens with NEWLINE, INDENT and DEDENT; an inconsistent dedent is a bad token."""
        out, classes, depth, levels, pending, fresh = [], lang.classes, 0, [0], "", True
        begun, bad = False, ix["bad"]
        for x in found:
            text = x if want is None else x.group(1) or ""
            if not text:
                continue
            if text[0] in "\r\n \t\f#\ufeff":
                if not depth:
                    if begun:
                        out.append(newline)
                        begun = False
                    pending, fresh = text, True
            else:
                if fresh and not depth:
                    space = pending[max(pending.rfind("\n"), pending.rfind("\r")) + 1:].replace("\f", "")
                    col = len(space.expandtabs(8))
                    if col > levels[-1]:
                        levels.append(col)
                        out.append(indent)
                    else:
                        while col < levels[-1]:
                            levels.pop()
                            out.append(dedent)
                        if col != levels[-1]:
                            out.append(bad)
                    fresh = False
                k = classes[text]
                if k in openers:
                    depth += 1
                elif k in closers:
                    depth -= 1 if depth else 0
                out.append(k)
                begun = True
            if want is not None and len(out) > want:
                return x.start()
        if want is not None:
            return -1
        if begun and not depth:
            out.append(newline)
        if not depth:
            out += [dedent] * (len(levels) - 1)
        return out

    prefix = r"(?:[rRbBfFtTuU]|[rR][bBfFtT]|[bBfFtT][rR])?"
    pattern = (
        r"\\\r?\n|((?:[ \t\f]*(?:#[^\r\n]*)?(?:\r\n|\n|\r))+[ \t\f]*|\A\ufeff?[ \t\f]+"
        r"|" + prefix + r"(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|" + _STRING + "|" + _STRING1 + r")"
        r"|[^\W\d]\w*|[()\[\]{};,]|" + _NUM + r"[jJ]?(?:(?=[^\w]|\Z)|(?=(?:and|else|for|if|in|is|or|not)\b))"
        r"|\.\.\.|:=|->|\*\*=?|//=?|<<=?|>>=?|[-+*/%&|^@=!<>]=|[^\s#\ufeff])|[ \t\f\v\ufeff]+|#[^\r\n]*|\s"
    )
    return Language("python", pattern, m, fixed, classify, layout)


# fixed values: languages by extension
EXTENSIONS = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx",
    "py": "python", "pyi": "python", "go": "go", "rs": "rust",
}
_MADE: dict[str, Language] = {}


def language(name: str) -> Language:
    if name not in _MADE:
        if name in ("tsx", "jsx"):  # elements are read as array literals
            _MADE[name] = copy.copy(language("typescript" if name == "tsx" else "javascript"))
            _MADE[name].name, _MADE[name].prepare = name, jsx.plain
            return _MADE[name]
        _MADE[name] = {"typescript": lambda: _javascript(True), "javascript": lambda: _javascript(False), "python": _python, "go": _go, "rust": _rust}[name]()
    return _MADE[name]
