"""Source files that do not parse: memoised parsing-with-derivatives over token streams.

Each file is read by the grammar of the language that its extension names (``grammars.EXTENSIONS``). An
empty derivative marks the failing token; a derivative that is not nullable at the end means truncation.
The pass is narrow: no shuffle, one row out for each row in; whole texts are read.

Defined results: null, empty and blank content is valid; a file without a known extension has verdict
``unknown`` and is never flagged; repeated rows give repeated verdicts (``found`` gives each id once); extra
columns are ignored; texts of any length are read, nesting is held in a list, not on the call stack.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import spread
from .grammars import EXTENSIONS, language

VERDICTS = "file_id bigint, workspace string, language string, verdict string, token int, line int"
_LINE = re.compile(r"\r\n|\r|\n")


def extension(file) -> F.Column:
    """Lower-case extension of a path, '' where there is none."""
    return F.lower(F.regexp_extract(file, r"\.([A-Za-z0-9]+)\s*$", 1))


def verdict(lang: str, content: str | None, place: bool = True) -> tuple[str, int | None, int | None]:
    """(verdict, index of the failing token, its line); both null where nothing fails."""
    if not content or content.isspace():
        return "valid", None, None
    reader = language(lang)
    if reader.prepare:
        content = reader.prepare(content)
    at = reader.check(content)
    if at == -1:
        return "valid", None, None
    if at == -2:
        return "truncated", None, len(_LINE.findall(content)) + 1
    if not place:
        return "unexpected", None, None
    offset = reader.offset(content, at)
    return "unexpected", reader.ordinal(content, at), len(_LINE.findall(content, 0, len(content) if offset < 0 else offset)) + 1


def syntax_verdicts(files: DataFrame) -> DataFrame:
    """file_id, workspace, language, verdict (valid, unexpected, truncated, unknown), token, line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spaces, exts, contents = (batch.column(i) for i in range(4))
            langs = [EXTENSIONS.get(e) for e in exts.to_pylist()]
            found = [verdict(k, c) if k else ("unknown", None, None) for k, c in zip(langs, contents.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [ids, spaces, pa.array(langs, pa.string()), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int32())],
                names=["file_id", "workspace", "language", "verdict", "token", "line"],
            )

    picked = files.select(F.col("file_id").cast("long"), F.col("workspace").cast("string"), extension(F.col("file")).alias("ext"), F.col("content").cast("string"))
    return spread(picked).mapInArrow(run, VERDICTS)


def found(files: DataFrame) -> DataFrame:
    """file_id of each file that is not valid in the language of its extension."""
    return syntax_verdicts(files).where(F.col("verdict").isin("unexpected", "truncated")).select("file_id").distinct()


def rates(files: DataFrame) -> DataFrame:
    """Per workspace and language: files, invalid and truncated ones, and the rate; grouped before any shuffle."""
    bad = F.col("verdict").isin("unexpected", "truncated")
    return (
        syntax_verdicts(files).where("language is not null").groupBy("workspace", "language")
        .agg(F.count("*").alias("files"), F.count_if(bad).alias("invalid"), F.count_if(F.col("verdict") == "truncated").alias("truncated"))
        .withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
    )
