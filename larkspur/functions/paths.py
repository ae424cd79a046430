"""Path expressions and the dimension of languages."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: languages by extension
LANGUAGES = {
    "ts": "typescript", "tsx": "tsx", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "cs": "csharp", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "rb": "ruby", "php": "php", "scala": "scala", "lua": "lua", "sh": "bash", "bash": "bash", "zig": "zig",
    "dart": "dart", "ex": "elixir", "exs": "elixir", "ml": "ocaml", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "css": "css", "vue": "vue", "md": "markdown", "sql": "sql",
}


def extension(path: Column) -> Column:
    """Lower-case extension without the dot, '' without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*LANGUAGES.items())])[extension(path)]


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """Everything before the last slash; '' for a bare name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def top_directory(path: Column, root: str = ".") -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"^/*([^/]+)/", 1)).otherwise(F.lit(root))


def fold_dots(path: Column) -> Column:
    """Without '.' and with each '..' taking its parent away."""
    step = lambda acc, x: F.when((x == ".") | (x == ""), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def ancestors(path: Column) -> Column:
    """The path and its parent directories, longest first, '' last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def short_name(name: Column) -> Column:
    """What follows the last dot of a qualified name."""
    return F.element_at(F.split(name, r"\."), -1)


def import_candidates(path: Column) -> Column:
    """Files an import path may mean, in order: itself, with extensions, without its own, as an index file."""
    exts = ["ts", "tsx", "js", "jsx", "mjs", "py"]
    bare = F.regexp_replace(path, r"\.(?:js|jsx|mjs|cjs|ts|tsx)$", "")
    made = [path] + [F.concat(path, F.lit("." + e)) for e in exts] + [F.concat(bare, F.lit("." + e)) for e in exts[:4]]
    made += [F.concat(path, F.lit("/index." + e)) for e in exts[:4]] + [F.concat(path, F.lit("/__init__.py"))]
    return F.array_distinct(F.array(*made))
