"""File trees as tables, and text files as numbered lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import LANGUAGES, ancestors, base_name, directory, extension

#: fixed values: what is never listed
IGNORED = ("node_modules", ".git", "dist", "build")
MAX_BYTES = 1_000_000


def listing(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, size, mtime) of every file under a root, relative; ``content`` is read only when asked for.

    Spark's own listing leaves out names that begin with a dot or an underscore.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", r"^(?:file:)?/*" + re.escape(root.strip("/")) + "/", "")
    cols = [rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    return df.select(*cols, *([F.col("content")] if content else []))


def source_files(listed: DataFrame, most: int = MAX_BYTES, ignore: Column | None = None) -> DataFrame:
    """Files of a known language below the size limit, outside of hidden and ignored directories."""
    hidden = directory(F.col("path")).rlike(r"(?:^|/)\.[^/]")
    out = listed.where(extension(F.col("path")).isin(*LANGUAGES) & (F.col("size") < most) & ~hidden)
    return out if ignore is None else out.where(~ignore)


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: ** any depth, * and ? within a name, {a,b} either, [..] a class."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(x)[1:-1] for x in pattern[i + 1:end].split(",")) + ")", end + 1
            continue
        if c == "[" and "]" in pattern[i + 1:]:
            end = pattern.index("]", i + 1)
            out, i = out + "[" + pattern[i + 1:end].replace("!", "^", 1) + "]", end + 1
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 1
    return "^" + out + "$"


def glob(listed: DataFrame, pattern: str, ignored: tuple = IGNORED) -> DataFrame:
    """Files that match, newest first, without dotfiles and ignored directories."""
    skip = F.col("path").rlike(r"(?:^|/)(?:" + "|".join(map(re.escape, ignored)) + r")/") | F.col("path").rlike(r"(?:^|/)\.")
    return listed.where(F.col("path").rlike(glob_regex(pattern)) & ~skip).orderBy(F.col("mtime").desc(), "path")


def ignore_predicate(path: Column, rules: list[str]) -> Column:
    """Ordered ignore rules (last match wins, ! negates, a trailing slash means directories) as one expression."""
    out = F.lit(False)
    for rule in rules:
        rule = rule.rstrip()
        if not rule or rule.startswith("#"):
            continue
        negated, rule = rule.startswith("!"), rule.lstrip("!")
        anchored, folder = "/" in rule.rstrip("/"), rule.endswith("/")
        body = glob_regex(rule.strip("/"))[1:-1]
        regex = ("^" if anchored else "(?:^|/)") + body + ("/" if folder else "(?:/|$)")
        out = F.when(path.rlike(regex), F.lit(not negated)).otherwise(out)
    return out


def tree(listed: DataFrame, depth: int = 2) -> DataFrame:
    """(path, parent, name, depth, is_dir, children): directories and files down to a depth; children counts all entries."""
    paths = listed.select("path", F.explode(ancestors(F.col("path"))).alias("entry")).where("entry <> ''")
    entries = paths.select("entry", (F.col("entry") != F.col("path")).alias("is_dir")).distinct()
    entries = entries.select(F.col("entry").alias("path"), directory(F.col("entry")).alias("parent"), base_name(F.col("entry")).alias("name"), F.size(F.split("entry", "/")).alias("depth"), "is_dir")
    counts = entries.groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("children"))
    return entries.join(counts, "path", "left").na.fill({"children": 0}).where(F.col("depth") <= depth).orderBy("parent", F.col("is_dir").desc(), "name")


def read_page(lines: DataFrame, offset: int = 1, limit: int = 2000, number: str = "line_no") -> DataFrame:
    """Lines from a 1-based offset on, by their number: no sort and no collected text."""
    return lines.where((F.col(number) >= offset) & (F.col(number) < offset + limit)).withColumn("shown", F.concat(F.lpad(F.col(number).cast("string"), 6, " "), F.lit("\t"), F.col("line")))


def is_binary(content: Column) -> Column:
    """A NUL in the first 4,096 bytes, or over 30% control bytes besides tab and line breaks; empty is text."""
    head = F.hex(F.substring(content, 1, 4096))
    pairs = F.regexp_replace(head, "(..)", "$1 ")
    controls = F.regexp_count(pairs, F.lit(r"\b(?:0[0-8BCEF]|1[0-9A-F]|7F)\b"))
    return (F.length(content) > 0) & (pairs.rlike(r"\b00\b") | (controls / (F.length(head) / 2) > 0.3))


#: fixed values: files that tell a language's root
DETECTORS = [
    ("typescript", "tsconfig.json"), ("javascript", "package.json"), ("python", "pyproject.toml"), ("python", "setup.py"), ("python", "requirements.txt"), ("rust", "Cargo.toml"), ("go", "go.mod"),
    ("java", "pom.xml"), ("java", "build.gradle"), ("kotlin", "build.gradle.kts"), ("swift", "Package.swift"), ("csharp", "*.csproj"), ("ruby", "Gemfile"), ("php", "composer.json"), ("elixir", "mix.exs"),
]


def language_roots(listed: DataFrame, depth: int = 3) -> DataFrame:
    """Distinct (language, root) by marker files down to a depth."""
    spark = listed.sparkSession
    rules = spark.createDataFrame(DETECTORS, "language string, marker string")
    shallow = listed.where(F.size(F.split("path", "/")) <= depth + 1).withColumn("name", base_name(F.col("path")))
    met = shallow.join(F.broadcast(rules), (F.col("name") == F.col("marker")) | (F.col("marker").startswith("*") & F.col("name").endswith(F.substring("marker", 2, 99))))
    return met.select("language", directory(F.col("path")).alias("root")).distinct()


def test_runners(manifests: DataFrame) -> DataFrame:
    """(root, runner) from (root, language, manifest text): dependencies decide, vitest before jest."""
    has = lambda name: F.col("manifest").rlike(rf'"{name}"\s*:')
    runner = (
        F.when(F.col("language").isin("typescript", "javascript"), F.when(has("vitest"), "vitest").when(has("jest"), "jest"))
        .when((F.col("language") == "python") & F.col("manifest").contains("pytest"), "pytest")
        .when(F.col("language") == "rust", "cargo").when(F.col("language") == "go", "go").when(F.col("language") == "swift", "swift")
    )
    return manifests.select("root", runner.alias("runner")).where("runner is not null").distinct()


def storage_bytes(listed: DataFrame, under: str = "") -> DataFrame:
    return listed.where(F.col("path").startswith(under)).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def expired(listed: DataFrame, now: Column, days: int = 7, prefix: str = "output-") -> DataFrame:
    """Spilled outputs past their time, to be deleted."""
    return listed.where(base_name(F.col("path")).startswith(prefix) & (F.col("mtime") < now - F.make_dt_interval(F.lit(days))))
