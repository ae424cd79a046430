"""Text expressions, all inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what typographic signs become before comparison
TYPOGRAPHY_FROM = "‘’‚‛“”„‟–—− …"
TYPOGRAPHY_TO = "''''\"\"\"\"--- ."


def lines(text: Column) -> Column:
    """Lines of a text; a trailing line break gives a last empty line."""
    return F.split(text, r"\r\n|\n|\r", -1)


def each_line(text: Column, change) -> Column:
    return F.array_join(F.transform(lines(text), change), "\n")


def trim_lines(text: Column) -> Column:
    return each_line(text, lambda x: F.trim(x))


def one_space(text: Column) -> Column:
    """Runs of white space as one blank, outer blanks removed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_indent(text: Column) -> Column:
    """Without the smallest indentation of the lines that have text."""
    width = lambda x: F.length(F.regexp_extract(x, r"^([ \t]*)", 1))
    least = F.coalesce(F.array_min(F.transform(F.filter(lines(text), lambda x: F.trim(x) != ""), width)), F.lit(0))
    return each_line(text, lambda x: F.when(F.trim(x) == "", "").otherwise(F.substr(x, least + 1)))


def unescape(text: Column) -> Column:
    """Written escapes as the signs they stand for."""
    for written, sign in ((r"\\n", "\n"), (r"\\t", "\t"), (r"\\r", "\r"), (r'\\"', '"'), (r"\\'", "'"), (r"\\\\\\\\", r"\\\\")):
        text = F.regexp_replace(text, written, sign)
    return text


def plain_signs(text: Column) -> Column:
    return F.translate(F.replace(text, F.lit("…"), F.lit("...")), TYPOGRAPHY_FROM[:-1], TYPOGRAPHY_TO[:-1])


def first_lines(text: Column, n: int = 3) -> Column:
    """The first n lines, with a last line of dots where more follow."""
    all_ = F.split(text, "\n", -1)
    return F.concat(F.array_join(F.slice(all_, 1, n), "\n"), F.when(F.size(all_) > n, F.lit("\n...")).otherwise(F.lit("")))


def token_estimate(size: Column) -> Column:
    """Four characters count as a token."""
    return F.ceil(size / F.lit(4.0)).cast("long")


def slug(text: Column, most: int = 40) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.regexp_replace(F.substring(made, 1, most), r"-+$", "")


def plan_id(goal: Column) -> Column:
    """A slug with a suffix from the goal's hash, so that equal goals give equal ids."""
    return F.concat_ws("-", slug(goal), F.substring(F.md5(goal), 1, 4))


def bytes_text(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024.0))
        .otherwise(F.format_string("%.1f MB", n / (1024.0 * 1024.0)))
    )


def lines_text(n: Column) -> Column:
    return F.when(n >= 1000, F.format_string("%.1fk", n / 1000.0)).otherwise(n.cast("string"))


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def shorten(text: Column, tokens: int, tail: bool = False) -> Column:
    """Head or tail of a text within a budget of tokens."""
    return F.right(text, F.lit(tokens * 4)) if tail else F.substring(text, 1, tokens * 4)


def summarise_field(value: Column, most: int = 200) -> Column:
    """A long log value as its size."""
    return F.when(F.length(value) > most, F.concat(F.lit("["), F.length(value).cast("string"), F.lit(" chars]"))).otherwise(value)
