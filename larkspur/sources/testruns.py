"""Output of test runners as tables: one summary row a run and one row a failure."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ASSERTION = "struct<ancestorTitles: array<string>, title: string, fullName: string, status: string, duration: double, failureMessages: array<string>>"
_SUITE = f"struct<name: string, startTime: double, endTime: double, status: string, assertionResults: array<{_ASSERTION}>>"
JSON_RUN = f"numPassedTests int, numFailedTests int, numPendingTests int, numTodoTests int, numTotalTests int, testResults array<{_SUITE}>"
GO_EVENT = "Action string, Package string, Test string, Elapsed double, Output string"


def noisy_json(text: str | None) -> str | None:
    """The first suffix from a brace or bracket on that is valid JSON as a whole."""
    if not text:
        return None
    text = text.rstrip()
    for i, c in enumerate(text):
        if c in "{[":
            try:
                json.loads(text[i:])
            except ValueError:
                continue
            return text[i:]
    return None


def _noisy_series(s: pd.Series) -> pd.Series:
    return s.map(noisy_json)


def clean_json(text: Column) -> Column:
    """``noisy_json`` of a column, batch by batch."""
    return F.pandas_udf(_noisy_series, "string")(text)


def _count(text: Column, pattern: str) -> Column:
    """Sum of all numbers that the pattern's first group finds."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.aggregate(F.transform(found, lambda x: x.cast("int")), F.lit(0), lambda a, x: a + x)


def json_run(runs: DataFrame, key: str = "id", noisy: bool = False) -> DataFrame:
    """Summary of a JSON reporter's run: statuses are counted from the assertions; pending and todo are skipped."""
    text = clean_json(F.col("stdout")) if noisy else F.col("stdout")
    run = runs.select(key, F.from_json(text, JSON_RUN).alias("r")).select(key, F.explode_outer("r.testResults").alias("s"))
    tests = run.select(key, (F.col("s.endTime") - F.col("s.startTime")).alias("ms"), F.col("s.assertionResults").alias("a"))
    n = lambda *w: F.sum(F.coalesce(F.size(F.filter("a", lambda x: x["status"].isin(*w))), F.lit(0)))
    return tests.groupBy(key).agg(n("passed").alias("passed"), n("failed").alias("failed"), n("pending", "skipped", "todo").alias("skipped"), F.coalesce(F.sum("ms"), F.lit(0.0)).alias("duration_ms")).withColumn("total", F.col("passed") + F.col("failed") + F.col("skipped"))


def json_counters(runs: DataFrame, key: str = "id") -> DataFrame:
    """The same from a run's own counters."""
    r = runs.select(key, F.from_json("stdout", JSON_RUN).alias("r"))
    c = lambda x: F.coalesce(F.col("r." + x), F.lit(0))
    return r.select(key, c("numPassedTests").alias("passed"), c("numFailedTests").alias("failed"), (c("numPendingTests") + c("numTodoTests")).alias("skipped"), c("numTotalTests").alias("total"))


def json_failures(runs: DataFrame, key: str = "id") -> DataFrame:
    """(key, file, suite, test, error, stack) of failed assertions."""
    t = runs.select(key, F.explode(F.from_json("stdout", JSON_RUN)["testResults"]).alias("s")).select(key, F.col("s.name").alias("file"), F.explode("s.assertionResults").alias("a")).where("a.status = 'failed'")
    error = F.try_element_at("a.failureMessages", F.lit(1))
    return t.select(key, "file", F.array_join("a.ancestorTitles", " > ").alias("suite"), F.col("a.title").alias("test"), error.alias("error"), stack(error).alias("stack"))


def stack(error: Column) -> Column:
    return F.array_join(F.filter(F.split(error, "\n"), lambda x: F.trim(x).startswith("at ")), "\n")


def pytest_run(runs: DataFrame, key: str = "id") -> DataFrame:
    t = F.col("stdout")
    one = lambda p: F.coalesce(F.regexp_extract(t, p, 1).try_cast("int"), F.lit(0))
    out = runs.select(key, one(r"(\d+) passed").alias("passed"), (one(r"(\d+) failed") + one(r"(\d+) errors?\b")).alias("failed"), one(r"(\d+) skipped").alias("skipped"), F.regexp_extract(t, r"in ([\d.]+)s", 1).alias("seconds"))
    return out.withColumn("total", F.col("passed") + F.col("failed") + F.col("skipped"))


def pytest_failures(runs: DataFrame, key: str = "id") -> DataFrame:
    lines = runs.select(key, F.explode(F.regexp_extract_all("stdout", F.lit(r"(?m)^FAILED (.+)$"), F.lit(1))).alias("_f"))
    where, error = F.split(F.regexp_extract("_f", r"^(\S+)", 1), "::"), F.regexp_extract("_f", r" - (.*)$", 1)
    return lines.select(key, where[0].alias("file"), F.array_join(F.slice(where, F.lit(2), F.greatest(F.size(where) - 2, F.lit(0))), "::").alias("suite"), F.element_at(where, -1).alias("test"), error.alias("error"))


def cargo_run(runs: DataFrame, key: str = "id") -> DataFrame:
    """All ``test result:`` lines are summed, one for each binary."""
    t = F.col("stdout")
    out = runs.select(key, _count(t, r"test result: \w+\. (\d+) passed").alias("passed"), _count(t, r"test result: [^\n]*?(\d+) failed").alias("failed"), _count(t, r"test result: [^\n]*?(\d+) ignored").alias("skipped"))
    return out.withColumn("total", F.col("passed") + F.col("failed") + F.col("skipped"))


def swift_run(runs: DataFrame, key: str = "id") -> DataFrame:
    t = F.col("stdout")
    out = runs.select(key, F.coalesce(F.regexp_extract(t, r"Executed (\d+) tests?", 1).try_cast("int"), F.lit(0)).alias("total"), F.coalesce(F.regexp_extract(t, r"Executed \d+ tests?, with (?:\d+ tests? skipped and )?(\d+) failures?", 1).try_cast("int"), F.lit(0)).alias("failed"), F.coalesce(F.regexp_extract(t, r"with (\d+) tests? skipped", 1).try_cast("int"), F.lit(0)).alias("skipped"))
    return out.withColumn("passed", F.col("total") - F.col("failed") - F.col("skipped"))


def go_events(runs: DataFrame, key: str = "id") -> DataFrame:
    lines = runs.select(key, F.posexplode(F.split("stdout", "\n")).alias("line_no", "_l")).where("_l like '{%'")
    return lines.select(key, "line_no", F.from_json("_l", GO_EVENT).alias("e")).select(key, "line_no", "e.*").where("Action is not null")


def go_run(runs: DataFrame, key: str = "id") -> DataFrame:
    e = go_events(runs, key)
    test = F.col("Test").isNotNull()
    return e.groupBy(key).agg(
        F.count_if(test & (F.col("Action") == "pass")).alias("passed"), F.count_if(test & (F.col("Action") == "fail")).alias("failed"), F.count_if(test & (F.col("Action") == "skip")).alias("skipped"),
        F.max_by(F.when(~test, F.col("Elapsed")), F.when(~test & F.col("Elapsed").isNotNull(), F.col("line_no"))).alias("seconds"),
    ).withColumn("total", F.col("passed") + F.col("failed") + F.col("skipped"))


def go_failures(runs: DataFrame, key: str = "id") -> DataFrame:
    """Failed tests with their output lines in order."""
    e = go_events(runs, key).where("Test is not null")
    out = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("Action") == "output", F.struct("line_no", "Output")))), lambda x: x["Output"]), "")
    return e.groupBy(key, "Package", "Test").agg(out.alias("error"), F.bool_or(F.col("Action") == "fail").alias("_bad")).where("_bad").drop("_bad")


def fallback_run(runs: DataFrame, key: str = "id") -> DataFrame:
    """Counts by words in any runner's text, with at most 5,000 characters of it kept for display."""
    t = F.concat_ws("\n", "stdout", "stderr")
    one = lambda p: F.coalesce(F.regexp_extract(t, p, 1).try_cast("int"), F.lit(0))
    return runs.select(key, one(r"(?i)(\d+)\s+pass").alias("passed"), one(r"(?i)(\d+)\s+fail").alias("failed"), one(r"(?i)(\d+)\s+skip").alias("skipped"), F.substring(t, 1, 5000).alias("raw"))


def status_lines(lines: DataFrame) -> DataFrame:
    """Lines of a run that name a test's result first: ``PASS file > title``."""
    shape = r"^(PASS|FAIL|SKIP) (\S+) > (.+)$"
    part = lambda n: F.regexp_extract("line", shape, n)
    return lines.where(F.col("line").rlike(shape)).withColumns({"status": part(1), "file": part(2), "test": part(3)})
