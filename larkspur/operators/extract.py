"""Symbols, imports, exports and type references of source text, as table functions.

Python is read by its own parser where it parses; the other languages (and broken Python) by line patterns with
balanced ends, which approximate a grammar: nested functions in expressions are not listed. Methods are qualified
by their class in every language. Arrow batches in, rows out; null and blank content gives none. The columns named in
``keep`` (workspace, file_id and the like) go along with every row, so equal paths of two workspaces stay apart.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.paths import language

SYMBOLS = "file string, name string, kind string, start_line int, end_line int, signature string, exported boolean, docs string"
IMPORTS = "file string, source string, names string, line int, is_relative boolean"
REFS = "file string, ref string"

_JS_MEMBER = re.compile(r"^\s+(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)\s+)*\*?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)([A-Za-z_$#][\w$]*)\s*(?:<[^>]*>)?\([^)]*\)?[^;]*\{\s*$")
#: (kind, pattern) of a declaration's first line, by language
DECLARATIONS = {
    "js": [
        ("class", re.compile(r"^(export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)")), ("interface", re.compile(r"^(export\s+)?interface\s+([A-Za-z_$][\w$]*)")),
        ("enum", re.compile(r"^(export\s+)?(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)")), ("type", re.compile(r"^(export\s+)?type\s+([A-Za-z_$][\w$]*)[^=]*=")),
        ("function", re.compile(r"^(export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)")),
        ("function", re.compile(r"^(export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)[^=]*=\s*(?:async\s+)?(?:function\b|\([^)]*\)?[^=]*=>|[\w$]+\s*=>)")),
        ("variable", re.compile(r"^(export\s+)(?:const|let|var)\s+([A-Za-z_$][\w$]*)")),
    ],
    "go": [("function", re.compile(r"^func\s+()([A-Za-z_]\w*)\s*[\[(]")), ("method", re.compile(r"^func\s+\([^)]*?(\w+)(?:\[[^\]]*\])?\)\s*([A-Za-z_]\w*)\s*\(")), ("interface", re.compile(r"^type\s+()(\w+)(?:\[[^\]]*\])?\s+interface\b")), ("class", re.compile(r"^type\s+()(\w+)(?:\[[^\]]*\])?\s+struct\b")), ("type", re.compile(r"^type\s+()(\w+)"))],
    "rust": [("function", re.compile(r"^\s*(pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*fn\s+(\w+)")), ("class", re.compile(r"^(pub(?:\([^)]*\))?\s+)?struct\s+(\w+)")), ("enum", re.compile(r"^(pub(?:\([^)]*\))?\s+)?enum\s+(\w+)")), ("interface", re.compile(r"^(pub(?:\([^)]*\))?\s+)?trait\s+(\w+)")), ("type", re.compile(r"^(pub(?:\([^)]*\))?\s+)?type\s+(\w+)"))],
    "jvm": [("class", re.compile(r"^\s*(public\s+)?(?:(?:abstract|final|static|sealed|data|open|internal|partial)\s+)*class\s+(\w+)")), ("interface", re.compile(r"^\s*(public\s+)?interface\s+(\w+)")), ("enum", re.compile(r"^\s*(public\s+)?enum\s+(?:class\s+)?(\w+)")), ("method", re.compile(r"^\s+(public\s+)?(?:(?:private|protected|internal|static|final|override|suspend|async|virtual|func|fun)\s+)*[\w<>\[\],.?]*\s*\b(?!if\b|for\b|while\b|switch\b|catch\b|return\b|new\b)(\w+)\s*\([^)]*\)[^;={]*\{\s*$"))],
    "python": [("class", re.compile(r"^\s*()class\s+(\w+)")), ("function", re.compile(r"^\s*()(?:async\s+)?def\s+(\w+)"))],
}
FAMILY = {"typescript": "js", "tsx": "js", "javascript": "js", "go": "go", "rust": "rust", "java": "jvm", "kotlin": "jvm", "csharp": "jvm", "swift": "jvm", "python": "python"}
_QUIET = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|//.*$")


def _end(lines: list[str], start: int) -> int:
    """The line on which the braces opened from ``start`` close; the line itself without any."""
    depth, opened = 0, False
    for i in range(start, len(lines)):
        x = _QUIET.sub("", lines[i])
        depth += x.count("{") - x.count("}")
        opened = opened or "{" in x
        if opened and depth <= 0:
            return i
        if not opened and (x.rstrip().endswith(";") or i - start > 8):
            return i
    return len(lines) - 1


def _python(text: str) -> Iterator[tuple] | None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines = text.split("\n")
    out: list[tuple] = []
    work = [(tree, "")]
    while work:
        node, scope = work.pop()
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(x, ast.ClassDef) else "method" if scope else "function"
                out.append((scope + x.name, kind, x.lineno, x.end_lineno, lines[x.lineno - 1].strip().rstrip(":"), not x.name.startswith("_"), " ".join((ast.get_docstring(x) or "").split()) or None))
                if kind == "class":
                    work.append((x, scope + x.name + "."))
            elif not scope and isinstance(x, ast.Assign) and isinstance(node, ast.Module):
                out += [(t.id, "variable", x.lineno, x.end_lineno, lines[x.lineno - 1].strip()[:120], not t.id.startswith("_")) for t in x.targets if isinstance(t, ast.Name)]
    return iter(sorted(out, key=lambda r: (r[2], r[0])))


_MARKS = re.compile(r"^(?:/\*+!?|///?!?|#+|\*+(?!/))\s?|\s*\*+/\s*$")
_BETWEEN = re.compile(r"\s*(?:@\w|#!?\[|\Z)")


def docs_above(lines: list[str], row: int) -> str | None:
    """The comment above a declaration, blank lines, decorators and attributes between; its marks taken off, on one line."""
    at = row - 1
    while at >= 0 and _BETWEEN.match(lines[at]):
        at -= 1
    if at < 0:
        return None
    last = lines[at].strip()
    first = at
    if last.endswith("*/"):
        while first and "/*" not in lines[first]:
            first -= 1
        if not lines[first].lstrip().startswith("/*"):
            return None
    elif last.startswith(("//", "#")):
        while first and lines[first - 1].strip().startswith(("//", "#")) and not _BETWEEN.match(lines[first - 1]):
            first -= 1
    else:
        return None
    said = (_MARKS.sub("", _MARKS.sub("", x.strip())).strip() for x in lines[first:at + 1])
    return " ".join(x for x in said if x) or None


def signature_at(lines: list[str], row: int, kind: str, python: bool = False) -> str:
    """The header of a declaration up to its body: of functions and methods over up to five lines."""
    text = lines[row].strip()
    if kind in ("function", "method"):
        for more in lines[row + 1:row + 5]:
            if (text.count("(") <= text.count(")") and text.endswith(":")) if python else ("{" in text or "=>" in text or text.endswith(";")):
                break
            text += " " + more.strip()
    if python:
        return text.rstrip(":").rstrip()
    return text.partition("{")[0].strip() or text


def symbols_of(lang: str, text: str) -> Iterator[tuple]:
    """(name, kind, start, end, signature, exported, docs) of a source text."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    for name, kind, start, end, _, exported, *said in _symbols(lang, text):
        yield name, kind, start, end, signature_at(lines, start - 1, kind, lang == "python"), exported, docs_above(lines, start - 1) or (said[0] if said else None)


def _symbols(lang: str, text: str) -> Iterator[tuple]:
    """(name, kind, start, end, header, exported, docstring of Python)."""
    family = FAMILY.get(lang)
    if family is None:
        return
    if family == "python":
        parsed = _python(text)
        if parsed is not None:
            yield from parsed
            return
    lines = text.split("\n")
    inside: list[tuple[str, int]] = []
    for i, x in enumerate(lines):
        while inside and i > inside[-1][1]:
            inside.pop()
        if family == "rust" and (m := re.match(r"^impl(?:<[^>]*>)?\s+(?:.*\bfor\s+)?(\w+)", x)):
            inside.append((m[1], _end(lines, i)))
            continue
        for kind, p in DECLARATIONS[family]:
            m = p.match(x)
            if not m:
                continue
            name, end = m[2], i if family == "python" else _end(lines, i)
            scope = m[1] if family == "go" and kind == "method" else inside[-1][0] if inside and x[:1] in " \t" else ""
            if scope and kind == "function":
                kind = "method"
            exported = name[:1].isupper() if family == "go" else not name.startswith("_") if family == "python" else bool(m[1])
            yield (f"{scope}.{name}" if scope else name), kind, i + 1, end + 1, x.split("{")[0].strip(), exported
            if kind in ("class", "interface", "enum") and end > i:
                inside.append((name, end))
            break
        else:
            if family == "js" and inside and (m := _JS_MEMBER.match(x)):
                yield f"{inside[-1][0]}.{m[1]}", "method", i + 1, _end(lines, i) + 1, x.split("{")[0].strip(), False


_IMPORT_PATTERNS = {
    "js": [re.compile(r"^\s*import\s+(?:type\s+)?(?:(.*?)\s+from\s+)?[\"']([^\"']+)[\"']"), re.compile(r"^\s*export\s+(.*?)\s+from\s+[\"']([^\"']+)[\"']"), re.compile(r"(?:const|let|var)\s+(.*?)\s*=\s*require\(\s*[\"']([^\"']+)[\"']")],
    "python": [re.compile(r"^\s*from\s+(?P<s>[.\w]+)\s+import\s+(?P<n>[^#\n]+)"), re.compile(r"^\s*import\s+(?P<s>[\w.]+)(?P<n>)")],
    "rust": [re.compile(r"^\s*(?:pub\s+)?use\s+(?P<s>[\w:]+)(?P<n>.*);")],
}


def imports_of(lang: str, text: str) -> Iterator[tuple]:
    """(source, names, line, is_relative); of an alias, the alias."""
    family = FAMILY.get(lang)
    block = False
    for i, x in enumerate(text.splitlines(), 1):
        if family == "go":
            block = (block or x.startswith("import (")) and not x.startswith(")")
            if (block or x.startswith("import ")) and (m := re.search(r'(\w+\s+)?"([^"]+)"', x)):
                yield m[2], (m[1] or "").strip(), i, m[2].startswith(".")
            continue
        for p in _IMPORT_PATTERNS.get(family, ()):
            m = p.search(x) if family == "js" else p.match(x)
            if m:
                source, clause = (m["s"], m["n"]) if family != "js" else (m[2], m[1] or "")
                names = [y.split(" as ")[-1].split(":")[-1].strip() for y in re.split(r"[{},()]", clause) if y.strip()]
                yield source, ",".join(n for n in names if re.fullmatch(r"[\w$*]+", n)), i, source.startswith((".", "crate", "self", "super"))
                break


_TYPE_CONTEXT = re.compile(r"(?::\s*|\bextends\s+|\bimplements\s+|\bnew\s+|->\s*|&(?:mut\s+)?|\*|<|\bas\s+|\|\s*|,\s*)([A-Z]\w*)")
BUILT_IN = frozenset("Array Map Set Promise Record Partial Readonly String Number Boolean Object Error Date Vec Option Result Box Self Some None Ok Err True False Math JSON".split())


def refs_of(text: str) -> list[str]:
    """Distinct names of types that a text refers to."""
    plain = re.sub(_QUIET.pattern, "", text, flags=re.MULTILINE)
    return sorted({m for m in _TYPE_CONTEXT.findall(plain) if m not in BUILT_IN})


def _table(files: DataFrame, schema: str, of, keep: tuple = ()) -> DataFrame:
    """Rows (keep, file, ...) of a reader over files."""
    kinds = dict(files.dtypes)
    names = [*keep, *(x.split()[0] for x in schema.split(", "))]
    whole = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [schema])
    arrow = to_arrow_schema(StructType.fromDDL(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            rows = [(*kept, f, *r) for f, k, c, *kept in zip(*cols) if c and k for r in of(k, c)]
            made = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(made, arrow)], names=names)

    return files.select("file", language(F.col("file")).alias("lang"), "content", *keep).mapInArrow(run, whole)


def symbols(files: DataFrame, keep: tuple = ()) -> DataFrame:
    return _table(files, SYMBOLS, symbols_of, keep)


def imports(files: DataFrame, keep: tuple = ()) -> DataFrame:
    return _table(files, IMPORTS, imports_of, keep)


def exports(files: DataFrame, keep: tuple = ()) -> DataFrame:
    return symbols(files, keep).where("exported and name not like '%.%'").select(*keep, "file", "name", "kind", F.col("start_line").alias("line"))


def type_references(files: DataFrame, keep: tuple = ()) -> DataFrame:
    return _table(files, REFS, lambda _, c: [(r,) for r in refs_of(c)], keep)


def resolve_imports(found: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Relative imports with the file they mean: the first candidate that is known. found: key, file, source; known: key, path."""
    from ..functions.paths import directory, fold_dots, import_candidates
    from .joins import first_candidate

    dots = F.regexp_extract("source", r"^(\.+)", 1)
    module = F.concat(F.repeat(F.lit("../"), F.greatest(F.length(dots) - 1, F.lit(0))), F.replace(F.regexp_replace("source", r"^\.+", ""), F.lit("."), F.lit("/")))
    path = F.when(F.col("file").endswith(".py"), module).otherwise(F.col("source"))
    target = fold_dots(F.concat_ws("/", directory(F.col("file")), path))
    rows = found.where("is_relative").withColumn("target", target)
    spread = rows.select(*key, "file", "source", "line", F.posexplode(import_candidates(F.col("target"))).alias("_p", "path"))
    met = spread.join(known.select(*key, "path").distinct(), [*key, "path"])
    return met.groupBy(*key, "file", "source", "line").agg(F.min_by("path", "_p").alias("resolved"))


def resolve_aliases(found: DataFrame, aliases: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Imports that an alias pattern (one * at most) maps to a known file: first pattern, then first target, then first candidate.

    found: key, file, source, line; aliases: key, ordinal, pattern, targets (with * for what the pattern's * took, below
    the base directory ``base``); known: key, path. Without a pattern that fits, the base directory itself is tried.
    """
    from ..functions.paths import fold_dots, import_candidates

    rows = found.where("not is_relative").select(*key, "file", "source", "line")
    head, tail = F.substring_index("pattern", "*", 1), F.substring_index("pattern", "*", -1)
    starred = F.contains("pattern", F.lit("*"))
    fits = F.when(starred, F.startswith("source", head) & F.endswith("source", tail) & (F.length("source") >= F.length("pattern") - 1)).otherwise(F.col("source") == F.col("pattern"))
    met = rows.join(aliases, key).where(fits)
    taken = F.when(starred, F.substr("source", F.length(head) + 1, F.length("source") - F.length("pattern") + 1)).otherwise(F.lit(""))
    mapped = met.select(*key, "file", "source", "line", "ordinal", F.coalesce("base", F.lit("")).alias("base"), taken.alias("_star"), F.posexplode("targets").alias("_t", "target"))
    mapped = mapped.withColumn("target", F.replace("target", F.lit("*"), F.col("_star"))).drop("_star")
    bare = rows.join(aliases.select(*key, "base").where("base is not null").distinct(), key).select(*key, "file", "source", "line", F.lit(2_000_000_000).alias("ordinal"), "base", F.lit(0).alias("_t"), F.col("source").alias("target"))
    paths = mapped.unionByName(bare).withColumn("target", fold_dots(F.concat_ws("/", "base", "target")))
    tried = paths.select(*key, "file", "source", "line", "ordinal", "_t", F.posexplode(import_candidates(F.col("target"))).alias("_p", "path"))
    hit = tried.join(known.select(*key, "path").distinct(), [*key, "path"])
    return hit.groupBy(*key, "file", "source", "line").agg(F.min_by("path", F.struct("ordinal", "_t", "_p")).alias("resolved"))


def resolve_modules(found: DataFrame, known: DataFrame, key: list[str], roots: tuple = ("", "src")) -> DataFrame:
    """Absolute Python imports (a.b) with the file they mean: a/b.py, then a/b/__init__.py, below each root in turn."""
    rows = found.where(F.col("file").endswith(".py") & ~F.col("is_relative"))
    path = F.replace("source", F.lit("."), F.lit("/"))
    made = F.array(*[F.concat(F.lit(r + "/" if r else ""), path, F.lit(end)) for r in roots for end in (".py", "/__init__.py")])
    tried = rows.select(*key, "file", "source", "line", F.posexplode(made).alias("_p", "path"))
    hit = tried.join(known.select(*key, "path").distinct(), [*key, "path"])
    return hit.groupBy(*key, "file", "source", "line").agg(F.min_by("path", "_p").alias("resolved"))
