"""Functions paired with their documentation, by recursive patterns of the ``regex`` library.

One pattern per language captures the comment run, the signature and the balanced body together; strings,
template literals, regex literals and comments are protected inside parameter lists and bodies by
recursive sub-patterns. A body is read again wherever a comment is followed by what any head needs. What has no
braces (Python's blocks, arrows and closures of one expression) ends by indentation or with the expression.
Overloads, abstract and interface methods of TypeScript and methods of Rust's traits count, without code.
A capture without content is dropped (``content``).

Defined results: a null or blank snippet and a file without a known extension give no rows; a cut snippet
counts as far as its signature is whole; repeated rows and repeated functions of a name count once per
symbol_id; ``docs``, ``signature`` and ``name`` of the input are not trusted and not read; texts of any
length are read whole; extra columns are ignored. The pass is narrow; only the distinct rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import spread
from .grammars import EXTENSIONS
from .syntax import extension

PAIRS = "symbol_id bigint, fn_name string, doc string, signature string, code string"

_S2, _S1 = r'"(?:[^"\\\n]|\\.)*+"', r"'(?:[^'\\\n]|\\.)*+'"
_JS_REGEX = r"(?<=[(,=:\[!&|?{};\n]\s?)/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/"
_STRINGS = {
    "javascript": rf"{_S2}|{_S1}|`(?:[^`\\]|\\.)*+`|{_JS_REGEX}",
    "go": rf"{_S2}|`[^`]*+`|'(?:[^'\\\n]|\\[^\n]+?)'",
    "rust": r'''b?r(?P<hash>\#*+)".*?"(?P=hash)|b?"(?:[^"\\]|\\.)*+"|'(?:[^'\\\n]|\\[^'\n]+?)\'''',
}
_NOT_NAMES = r"(?!(?:if|for|while|switch|catch|return|function|with|do|else|typeof|await|new|throw|in|of|delete|void|yield|super|import|case|match|loop|unsafe)\b)"
_HEADS = {
    "javascript": rf"""
        (?:export\s++)?+(?:default\s++)?+(?:declare\s++)?+
        (?: (?:async\s++)?+function\b\s*+\*?+\s*+(?P<name>[\w$]++)\s*+(?&angle)?+\s*+(?&par)(?&ret)?+\s*+(?:(?&com)\s*+)*+(?=[{{;])
          | (?:(?:const|let|var|public|private|protected|static|readonly|override)\s++)*+(?:[\w$]++\s*+\.\s*+)*+(?P<name>[\w$]++)\s*+(?:\??:\s*+(?:=>|\{{[^{{}}\n]*+\}}|[^=;{{}}\n])++)?(?:=(?![=>])|:(?=\s*+(?:async\b\s*+)?+(?:function\b|(?&par)\s*+=>)))\s*+
            (?:async\b\s*+)?+(?:function\b\s*+\*?+\s*+[\w$]*+\s*+(?&angle)?+\s*+(?&par)(?&ret)?+\s*+(?:(?&com)\s*+)*+(?=\{{) | (?:(?&angle)?+(?&par)(?:\s*+:\s*+(?:[^={{}}();]|(?&par)|(?&brc))++)?+|[\w$]++)\s*+=>\s*+)
          | (?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)\s++(?=[\w$\#*\[]))*+\*?+\s*+{_NOT_NAMES}\#?+(?P<name>[\w$]++)\s*+\??+(?&angle)?+\s*+(?&par)(?:(?&ret)\s*+(?:(?&com)\s*+)*+(?=[{{;])|\s*+(?:(?&com)\s*+)*+(?=\{{)) )
    """,
    "go": r"""
        (?: func\s*+(?:(?&par)\s*+)?+(?P<name>\w++)\s*+(?&sq)?+\s*+(?&par)(?&res)
          | (?:var\s++|const\s++)?+(?P<name>\w++)\s*+(?:func(?&par)[^={\n]*+)?+:?+=\s*+func\s*+(?&par)(?&res)(?=\{) )
    """,
    "rust": r"""
        (?: (?:pub(?:\s*+\([^)]*+\))?+\s++)?+(?:(?:default|const|async|unsafe|extern(?:\s*+"[^"]*+")?+)\s++)*+fn\s++(?P<name>(?:r\#)?+\w++)\s*+(?&angle)?+\s*+(?&par)(?:(?&array)|[^{;])*+
          | (?:let|const|static)\s++(?:mut\s++)?+(?P<name>\w++)\s*+(?::(?:(?&array)|[^=;])++)?+=\s*+(?:async\s++)?+(?:move\s++)?+\|[^|]*+\|\s*+(?:->\s*+(?:(?&array)|[^{;])*+)?+ )
    """,
}


def _braced(lang: str) -> re.Pattern:
    attr = {"javascript": r"@[\w$.]++(?:[ \t]*+(?&par))?+", "go": r"(?!)", "rust": r"\#!?\[(?:[^\[\]\"]++|(?&str)|\[[^\]]*+\])*+\]"}[lang]
    plain = "`[^`\\\\]*+`|" if lang != "rust" else ""  # what needs no call comes first
    return re.compile(
        rf"""(?(DEFINE)
        (?P<str>{_STRINGS[lang]})
        (?P<com>//[^\n]*+|/\*.*?(?:\*/|\Z))
        (?P<par>\((?:[^()"'`/]++|"[^"\\\n]*+"|(?&com)|(?&str)|(?&par)|["'`/])*+\))
        (?P<body>\{{(?:[^{{}}"'`/]++|"[^"\\\n]*+"|//[^\n]*+|{plain}(?&com)|(?&str)|(?&body)|["'`/])*+(?:\}}|\Z))
        (?P<brc>\{{(?:[^{{}}]++|(?&brc))*+\}})
        (?P<sq>\[(?:[^\[\]]++|(?&sq))*+\])
        (?P<angle><(?:[^<>;{{}}]|(?&angle)|(?<=[-=])>|(?&brc))*+>)
        (?P<ret>\s*+:\s*+(?:[^{{}}();=]|=>|(?&par)|(?<=(?:[:|&<,\[]|=>)\s*)(?&brc)(?=\s*+[\[{{>|&,;\]]))*+)
        (?P<res>\s*+(?&par)?+(?:\b(?:interface|struct)\s*+(?&brc)|[^{{\n])*+)
        (?P<array>\[(?:[^\[\]{{}}]|\[[^\[\]{{}}]*+\])*+\])
        )
        (?:^|(?<=[{{}};,][ \t]*)(?=/\*(?:[^*]++|\*(?!/))*+\*/[ \t]*+[^\s/]))(?P<doc>(?:[ \t]*+(?:(?:(?&com)|{attr})[ \t]*+\r?+\n?+|\r?+\n))*+)[ \t]*+(?P<sig>{_HEADS[lang]})(?P<code>(?&body))?+
        |^(?:[ \t]*+(?:(?:(?&com)|{attr})[ \t]*+\r?+\n?+|\r?+\n))++|(?&str)|(?&com)|[^"'`/\n]++\n?+|.""",
        re.VERBOSE | re.MULTILINE | re.DOTALL | re.VERSION0,
    )


_TRIPLE = r'"""(?:[^"\\]|\\.|"(?!""))*+(?:"""|\Z)|' + r"'''(?:[^'\\]|\\.|'(?!''))*+(?:'''|\Z)"
_PYTHON = re.compile(
    rf"""(?(DEFINE)
    (?P<str>{_TRIPLE}|{_S2}|{_S1})
    (?P<par>\((?:[^()"'\#]++|\#[^\n]*+|(?&str)|(?&par)|["'])*+\))
    (?P<sq>\[(?:[^\[\]"']++|(?&str)|(?&sq)|["'])*+\])
    )
    ^(?=[ \t]*+(?:[\#@\r\n]|async\b|def\b|\w++[ \t]*+(?::[^=\n]++)?=[ \t]*+lambda\b))(?P<doc>(?:[ \t]*+(?:\#[^\n]*+|@[\w.]++(?:[ \t]*+(?:(?&par)|(?&sq)|\.\w++))*+[ \t]*+(?:\#[^\n]*+)?+)?+\r?+\n)*+)(?P<ind>[ \t]*+)
    (?P<sig>(?:async[ \t]++)?+def[ \t]++(?P<name>\w++)[ \t]*+(?&sq)?+[ \t]*+(?&par)(?:[ \t]*+->(?:[^:\n"'\[]|(?&str)|(?&sq))++)?+[ \t]*+:|(?P<name>\w++)[ \t]*+(?::[^=\n]++)?+=[ \t]*+lambda\b)
    (?P<tail>(?:[ \t]*+(?:\#[^\n]*+)?+\r?+\n)*+[ \t]*+(?:[rRuU]?+(?P<string>(?&str)))?+)
    |^(?:[ \t]*+(?:\#[^\n]*+|@[\w.]++(?:[ \t]*+(?:(?&par)|(?&sq)|\.\w++))*+[ \t]*+(?:\#[^\n]*+)?+)?+\r?+\n)++|(?&str)|\#[^\n]*+|[^"'\#\n]++\n?+|.""",
    re.VERBOSE | re.MULTILINE | re.DOTALL | re.VERSION0,
)
_PATTERNS: dict[str, re.Pattern] = {}
#: one of these follows the comment of any function that the heads know; a body without is not read again
_INNER = {"javascript": re.compile(r"\{|=>|\)\s*:|\bfunction\b"), "go": re.compile("func"), "rust": re.compile(r"fn|\|")}


def _may_hold(key: str, code: str) -> bool:
    """Whether a body can hold a documented function: a necessary condition only, the pattern decides."""
    starts = [i for i in (code.find("//"), code.find("/*")) if i >= 0]
    return bool(starts) and _INNER[key].search(code, min(starts)) is not None


#: the rest of a line of Python with the lines that brackets, strings and backslashes join to it
_PY_REST = re.compile(
    rf"""(?(DEFINE)
    (?P<str>{_TRIPLE}|{_S2}|{_S1})
    (?P<br>[(\[{{](?:[^()\[\]{{}}"'\#]++|\#[^\n]*+|(?&str)|(?&br)|["'])*+(?:[)\]}}]|\Z))
    )
    (?:[^"'\#\n\\()\[\]{{}}]++|\\\n?+|(?&str)|(?&br)|\#[^\n]*+|[^\n])*+""",
    re.VERBOSE | re.DOTALL | re.VERSION0,
)
_PY_BLANK = re.compile(r"[ \t\f]*+(?:\#[^\n]*+)?+(?:\n|\Z)")
_INDENT = re.compile(r"[ \t\f]*+")


def _python_end(text: str, at: int, indent: str, block: bool) -> int:
    """Where the function of that indent ends whose signature ends at ``at``: with its line, or its indented block."""
    end = at = _PY_REST.match(text, at).end()
    outer = len(indent.expandtabs())
    while block and at < len(text):
        at += 1  # the line break
        width = len(_INDENT.match(text, at).group().expandtabs())
        blank = _PY_BLANK.match(text, at)
        if blank is not None:
            at = blank.end() - blank.group().endswith("\n")
            if width > outer and "#" in blank.group():
                end = at
            continue
        if width <= outer:
            break
        end = at = _PY_REST.match(text, at).end()
    return end


_CLOSED = re.compile(
    r"""(?(DEFINE)
    (?P<str>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`)
    (?P<br>[(\[{](?:[^()\[\]{}"'`/]++|(?&com)|(?&str)|(?&br)|["'`/])*+(?:[)\]}]|\Z))
    (?P<com>//[^\n]*+|/\*.*?(?:\*/|\Z))
    )
    \s*+(?P<code>(?:[^\s;,()\[\]{}"'`/]++|[ \t]++|(?&com)|(?&str)|(?&br)|["'`/]|\s++(?=[.?:&|+\-*%=<>^/])|(?<=[=+\-*%&|?:<>^])\s++)*+)""",
    re.VERBOSE | re.DOTALL | re.VERSION0,
)


def _expression(text: str, at: int) -> str:
    """The expression that is the body of an arrow or a closure, up to the end of its statement or list element."""
    return _CLOSED.match(text, at)["code"].strip()


# what says nothing; fixed word lists
FILLERS = frozenset("the a an this that these those method function func fn helper procedure routine constructor class of for to and or is it its does do will".split())
PLACEHOLDER = re.compile(
    r"(?:todo|fixme|xxx|tbd|tba|hack|wip|n/?a|none|placeholder|undocumented|_summary_|_description_|_type_|_extended_summary_|(?:add|insert|write|missing|needs?)\s+(?:a\s+|the\s+|some\s+)?(?:docs?|description|documentation|docstring|comments?|summary)(?:\s+(?:here|later))?"
    r"|(?:description|documentation|docs?|docstring|summary|comment)(?:\s+(?:goes?\s+here|here|missing|pending|to\s+come|tbd))?|no\s+(?:description|documentation|docs?|comment)(?:\s+(?:available|provided|yet))?|document(?:\s+(?:me|this|it))?|describe(?:\s+(?:me|this|it))?|write\s+(?:me|this)|lorem\s+ipsum.*)",
    re.IGNORECASE,
)
_MARKED = re.compile(r"(?:todo|fixme|xxx|hack)\b[\s:(\[\-]*(?:\w+\)\s*:?\s*)?", re.IGNORECASE)
DIRECTIVE = re.compile(
    r"(?:@ts-[\w-]+|ts-[\w-]+|eslint(?:-[\w-]+)?\b.*|tslint:.*|prettier-ignore.*|biome-ignore.*|istanbul\s+ignore.*|c8\s+ignore.*|v8\s+ignore.*|jshint\b.*|jscs:.*|@flow.*|@?no(?:inspection|lint|qa|sonar)\b.*|nosec\b.*|stylelint-.*|webpack\w*:.*|@__\w+__.*|\#__\w+__.*"
    r"|fmt:\s*\w+.*|yapf:\s*\w+.*|type:\s*ignore.*|mypy:.*|pyright:.*|pylint:.*|flake8:.*|isort:.*|ruff:.*|pragma\b.*|black:.*|coverage:.*|noqa\b.*|-\*-.*-\*-|coding[:=].*"
    r"|go:\w+.*|\+build\b.*|nolint\b.*|lint:\w+.*|export\s+\w+$|line\s+\S+:\d+|clippy:+.*|rustfmt[-:_]\w+.*|allow\([\w:,\s]+\)|cspell:.*|spell-?checker:.*|\#?(?:end)?region\b.*|@formatter:\w+|vim?:.*|@internal|@private|@public|@override|@inheritdoc|\{@inheritdoc\}|sourcemappingurl=.*)",
    re.IGNORECASE,
)
LICENCE = re.compile(
    r"(?:spdx-|copyright\b|\(c\)\s|©|©|licen[sc]ed?\s+(?:under|to)\b|use\s+of\s+this\s+source|all\s+rights\s+reserved|this\s+(?:file|source|code|program|software)\s+is\s+(?:part\s+of|licen[sc]ed|subject|distributed|free)|redistribution\b|permission\s+is\s+hereby|copied\s+from\s+\S+|vendored\s+from|code\s+generated\b|auto-?generated\b|@licen[sc]e|@copyright|@preserve"
    r"|(?:distributed|released|available)\s+under\s+(?:the\s+)?(?:terms|mit|bsd|apache|gpl|isc|mpl))|.*\(c\)\s.*\|.*|.*\ball\s+rights\s+reserved\b",
    re.IGNORECASE,
)
SECTIONS = frozenset("internal internals private public helpers helper utils utilities utility api types constants imports exports misc main setup teardown tests globals config lifecycle handlers hooks methods functions getters setters accessors".split())
_SECTION = re.compile(r"(?:section|region)\s*[:\-]", re.IGNORECASE)
_WORDS = re.compile(r"\w+")
_ASSIGNED = re.compile(r"[\w$]\s*[:]?=\s*[\w$]")
_PARAMETER = re.compile(r"^\s*+[\[\]\w$.=]++\s*+")
_TAG = re.compile(r"(?:@|:|\\)(?P<tag>[A-Za-z]\w*+)(?P<rest>.*)", re.DOTALL)
_NAMED_TAGS = frozenset("param parameter arg argument key keyword property prop raises raise throws exception template typeparam var ivar cvar type rtype return returns yields yield".split())
_TYPED = re.compile(r"\s*+\{(?:[^{}]|\{[^{}]*+\})*+\}")
_WORD = re.compile(r"[^\W\d_]++(?:['’][^\W\d_]++)*+")
_NAME_PART = re.compile(r"[A-Z]++(?![a-z])|[A-Z]?[a-z]++|[^\W\d_a-zA-Z]++")
_RULER = re.compile(r"(?:[-=#*~_+/<>.·─━═–—|:\s])*+")
_CODE = re.compile(
    r"(?:[\w$.\[\]*&]+(?:\s*:\s*[\w<>\[\]|]+)?\s*(?::?=|[-+*/|&]=)(?!=)\s*\S.*|(?:const|let|var|return|await|del|pub|fn|func|def|class|import|use|package|export|if|for|while|elif|switch|match|raise|throw|defer|go|print)\b.*[;{:)]|(?:return|break|continue|pass|else|try)\b[^.]{0,40};?|[\w$.:!]+\([^)]*\)[;,{]?|.*[;{}]|[)}\]]+[;,]?)"
)
_PROSE_CODE = re.compile(r"^(?:[A-Z][a-zà-ÿ]+|[a-zà-ÿ]+)\s+[a-zà-ÿ]+\s+[a-zà-ÿ]+\s+[a-zà-ÿ]+")


def _stem(word: str) -> str:
    w = word.lower()
    for end in ("ing", "ies", "es", "ed", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    return w.rstrip("e").rstrip("i").rstrip("y")


_STEMS: dict[str, str] = {}


def stem(word: str) -> str:
    got = _STEMS.get(word)
    if got is None:
        got = _stem(word)
        if len(_STEMS) < 50_000:
            _STEMS[word] = got
    return got


_FILLER_STEMS = frozenset(map(_stem, FILLERS))


def _says(line: str, name: frozenset[str], params: bool = True) -> bool:
    """Whether a cleaned line of documentation has content of its own."""
    tag = _TAG.fullmatch(line)
    if tag:
        rest = _TYPED.sub(" ", tag["rest"])
        if tag.group()[0] == ":":  # :param type name: text
            rest = rest.partition(":")[2]
        elif tag["tag"].lower() in ("param", "parameter", "arg", "argument", "property", "prop", "template", "typeparam", "key", "keyword"):
            rest = _PARAMETER.sub("", rest)
        rest = rest.strip(" -–—:")
        return bool(_WORD.search(rest)) and not PLACEHOLDER.fullmatch(rest.strip(" .[]<>()_*!"))
    marked = _MARKED.match(line)
    if marked:
        line = line[marked.end():]
    bare = line.strip(" .[]<>()*!:-–—…_`\"'")
    if not bare or PLACEHOLDER.fullmatch(bare) or PLACEHOLDER.fullmatch(line.strip(" .")):
        return False
    if marked and PLACEHOLDER.fullmatch("add " + bare):
        return False
    words = _WORD.findall(bare)
    if not words:
        return False
    left = [w for w in words if (s := stem(w)) not in name and s not in _FILLER_STEMS]
    if not left:
        return False
    if len(words) <= 3:  # a name split in another way, as in snake_case or one word
        parts = {stem(p) for w in words for p in _NAME_PART.findall(w)}
        if parts <= name | _FILLER_STEMS:
            return False
    return True


def content(lines: list[str], name: str, brief: bool = False) -> list[str]:
    """The lines of a comment run that document a function of that name (brief: the first); empty if none does."""
    parts = frozenset(stem(p) for p in _NAME_PART.findall(name))
    cleaned = [x.strip() for x in lines]
    rulers = [len(x) >= 3 and _RULER.fullmatch(x) is not None for x in cleaned]
    out = []
    for i, x in enumerate(cleaned):
        if not x or rulers[i]:
            continue
        body = x.strip("-=#*~─━═ ")
        titled = (i and rulers[i - 1]) or (i + 1 < len(cleaned) and rulers[i + 1]) or (len(x) - len(body) >= 6 and x[:2] == x[-2:])
        if titled and len(body.split()) <= 5 and not body.endswith("."):
            continue
        if DIRECTIVE.fullmatch(body) or LICENCE.match(x) or all(w in SECTIONS for w in _WORDS.findall(body.lower())):
            continue
        if _SECTION.match(body):
            continue
        if _CODE.fullmatch(x) and not (_PROSE_CODE.match(x) and not x.endswith((";", "{", "}")) and not _ASSIGNED.search(x)):
            continue
        if _says(x, parts):
            out.append(x)
            if brief:
                break
    return out


_OPEN = re.compile(r"(?:/\*\*?!?|///?!?|#+!?(?!\[))")


def comment_lines(run: str, python: bool) -> list[str]:
    """The text lines of a comment run without comment signs; decorators and attributes are left out."""
    out, block = [], False
    for raw in run.splitlines():
        x = raw.strip()
        if block:
            end = x.find("*/")
            text = x if end < 0 else x[:end]
            out.append(text.strip().lstrip("*").strip() if text.strip().strip("*") else "")
            block = end < 0
        elif python:
            if x.startswith("#"):
                out.append(x.lstrip("#!").strip() if x.strip("#") else x)
        elif x.startswith("//"):
            out.append(x.lstrip("/!").strip() if x.strip("/") else x)
        elif x.startswith("/*"):
            end = x.find("*/", 2)
            text = x[2:] if end < 0 else x[2:end]
            out.append(text.strip().strip("*!").strip() if text.strip("* !") else "")
            block = end < 0
    return out


def pairs(lang: str, snippet: str, brief: bool = False) -> Iterator[tuple[str, str, str, str]]:
    """(name, documentation, signature, code) of each documented function of a snippet; brief: its first line is enough."""
    if "\r" in snippet:
        snippet = snippet.replace("\r\n", "\n").replace("\r", "\n")
    if lang == "python":
        for m in _PYTHON.finditer(snippet):
            if m["sig"] is None:
                continue
            lines = comment_lines(m["doc"], True) if m["doc"] and "#" in m["doc"] else []
            text = m["string"]
            if text:
                text = text.strip()
                quote = 3 if text[:3] in ('"""', "'''") else 1
                inner = text[quote:-quote] if len(text) >= 2 * quote and text.endswith(text[:quote]) else text[quote:]
                lines = lines + [""] + inner.split("\n")
            if lines and (said := content(lines, m["name"], brief)):
                code = "" if brief else snippet[m.start():_python_end(snippet, m.end("sig"), m["ind"], m["sig"].endswith(":"))].lstrip("\n")
                yield m["name"], "\n".join(said), m["sig"], code
        return
    key = "javascript" if lang in ("typescript", "tsx", "jsx") else lang
    if key not in _PATTERNS:
        _PATTERNS[key] = _braced(key)
    work = [snippet]
    while work:
        text = work.pop()
        for m in _PATTERNS[key].finditer(text):
            sig = m["sig"]
            if sig is None:
                continue
            doc, code = m["doc"], m["code"]
            if doc and ("//" in doc or "/*" in doc):
                name = m["name"].removeprefix("r#").lstrip("#")
                if said := content(comment_lines(doc, False), name, brief):
                    if not code and not brief and sig.rstrip().endswith(("=>", "|")):
                        code = _expression(text, m.end("sig"))
                    yield name, "\n".join(said), sig.strip(), code or ""
            if m["code"] and _may_hold(key, code):
                work.append(code[1:])


def documented(symbols: DataFrame, brief: bool = False) -> DataFrame:
    """symbol_id, fn_name, doc, signature, code of each documented function in each row's snippet; brief: ids and names only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (i, *p)
                for i, e, s in zip(*(batch.column(k).to_pylist() for k in range(3)))
                if s and (lang := EXTENSIONS.get(e))
                for p in pairs(lang, s, brief)
            ]
            cols = list(zip(*rows)) or [()] * 5
            if brief:
                cols[2:] = [[None] * len(cols[0])] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["symbol_id", "fn_name", "doc", "signature", "code"])

    picked = symbols.select(F.col("symbol_id").cast("long"), extension(F.col("file")).alias("ext"), F.col("snippet").cast("string"))
    return spread(picked).mapInArrow(run, PAIRS)


def found(symbols: DataFrame) -> DataFrame:
    """symbol_id, fn_name of each documented function, once."""
    return documented(symbols, brief=True).select("symbol_id", "fn_name").distinct()
