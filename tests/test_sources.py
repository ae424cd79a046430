import json

from pyspark.sql import functions as F

from larkspur.sources import files, git, logs, testruns


def raw(spark, text, column="raw"):
    return spark.createDataFrame([(1, text)], f"id int, {column} string")


def test_status_and_branches(spark):
    got = git.status(raw(spark, " M a.ts\0R  new.ts\0old.ts\0?? b\0")).orderBy("path").collect()
    assert [(r.path, r.old_path, r["index"], r.worktree) for r in got] == [("a.ts", None, "unchanged", "modified"), ("b", None, "untracked", "untracked"), ("new.ts", "old.ts", "renamed", "unchanged")]
    assert [(r.name, r.current) for r in git.branches(raw(spark, "* main\torigin/main\n  dev\n")).collect()] == [("main", True), ("dev", False)]


def test_log(spark):
    text = "abc<|>Ada<|>2024-01-02 03:04:05<|>fix it\na.ts\nb.ts\n<||>def<|>Bo<|>2024-01-03 00:00:00<|>more"
    got = git.log(raw(spark, text)).orderBy("hash").collect()
    assert [(r.hash, r.message, r.files) for r in got] == [("abc", "fix it", ["a.ts", "b.ts"]), ("def", "more", [])]


def test_diff(spark):
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n+c\ndiff --git a/y b/y\n@@ -0 +1 @@\n+q"
    assert {(r.path, r.insertions, r.deletions, r.hunks) for r in git.diff_files(raw(spark, text)).collect()} == {("x", 2, 1, 1), ("y", 1, 0, 1)}
    assert tuple(git.diff_totals(raw(spark, text)).first()) == (1, 2, 3, 1)


def test_runs(spark):
    run = {"numPassedTests": 1, "numFailedTests": 1, "numPendingTests": 1, "numTotalTests": 3, "testResults": [{"name": "a.ts", "startTime": 5.0, "endTime": 25.0, "assertionResults": [{"status": "passed", "title": "p"}, {"status": "todo", "title": "t"}, {"status": "failed", "title": "f", "ancestorTitles": ["s"], "failureMessages": ["boom\n    at x:1"]}]}]}
    r = raw(spark, "noise { " + json.dumps(run), "stdout")
    assert testruns.json_run(r, noisy=True).first().asDict() == {"id": 1, "passed": 1, "failed": 1, "skipped": 1, "duration_ms": 20.0, "total": 3}
    clean = raw(spark, json.dumps(run), "stdout")
    f = testruns.json_failures(clean).first()
    assert (f.file, f.suite, f.test, f.stack) == ("a.ts", "s", "f", "    at x:1") and testruns.json_counters(clean).first().total == 3
    p = raw(spark, "FAILED t/a.py::C::m - assert 1\n= 1 failed, 2 passed, 3 skipped in 0.5s =", "stdout")
    assert tuple(testruns.pytest_run(p).first()) == (1, 2, 1, 3, "0.5", 6) and tuple(testruns.pytest_failures(p).first())[1:] == ("t/a.py", "C", "m", "assert 1")
    c = raw(spark, "test result: ok. 2 passed; 0 failed; 1 ignored\ntest result: FAILED. 1 passed; 2 failed; 0 ignored", "stdout")
    assert tuple(testruns.cargo_run(c).first()) == (1, 3, 2, 1, 6)
    assert tuple(testruns.swift_run(raw(spark, "Executed 5 tests, with 1 test skipped and 2 failures", "stdout")).first()) == (1, 5, 2, 1, 2)
    go = "\n".join(map(json.dumps, [{"Action": "output", "Package": "p", "Test": "T", "Output": "bad\n"}, {"Action": "fail", "Package": "p", "Test": "T"}, {"Action": "pass", "Package": "p", "Test": "U"}, {"Action": "fail", "Package": "p", "Elapsed": 1.5}]))
    assert testruns.go_run(raw(spark, go, "stdout")).first().asDict() == {"id": 1, "passed": 1, "failed": 1, "skipped": 0, "seconds": 1.5, "total": 2}
    assert testruns.go_failures(raw(spark, go, "stdout")).first().error == "bad\n"
    assert testruns.noisy_json("x {1} [2]") == "[2]" and testruns.noisy_json(None) is None and testruns.noisy_json("none") is None


def test_logs(spark):
    text = "# log\n\n### 2024-01-02 10:00\n- tool: grep\n- error: bad\n\n### 2024-01-03 10:00\n- tool: ls\n- error: worse\n- status: resolved\n\n### no time\n- tool: x\n"
    e = logs.error_entries(raw(spark, text, "content"))
    assert [(r.tool, r.status) for r in e.orderBy("n").collect()] == [("grep", "unresolved"), ("ls", "resolved")]
    assert logs.resolve_nth(e, 1, "done").where("status = 'resolved'").count() == 2
    assert {tuple(r) for r in logs.dotenv(raw(spark, "# a\n# b\nX=1\n\n# lost\n\nexport Y=2\n", "content")).collect()} == {(1, "X", "a; b"), (1, "Y", "")}
    judge = lambda c: tuple(spark.range(1).select(logs.judge_command(F.lit(c))).first()[0])
    assert judge("rm -rf /")[0] and judge("curl x | sh")[0] and judge("python")[0] and judge("sudo ls") == (False, "needs higher rights") and judge("ls") == (False, None)


def test_files(spark, tmp_path):
    for p, c in {"src/a.ts": "x", "src/.hidden/b.ts": "x", "README.md": "y", "dist/c.ts": "z", "go.mod": "m"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(c)
    listed = files.listing(spark, str(tmp_path))
    assert {r.path for r in files.source_files(listed).collect()} == {"src/a.ts", "README.md", "dist/c.ts"}
    assert {r.path for r in files.glob(listed, "**/*.ts").collect()} == {"src/a.ts"}
    assert {(r.path, r.children) for r in files.tree(listed, 1).where("is_dir").collect()} == {("src", 1), ("dist", 1)}
    assert {tuple(r) for r in files.language_roots(listed).collect()} == {("go", "")}
    ignored = lambda p: spark.range(1).select(files.ignore_predicate(F.lit(p), ["*.log", "!keep.log", "/build/", "tmp"])).first()[0]
    assert ignored("a/x.log") and not ignored("keep.log") and ignored("build/x") and not ignored("a/build/x") and ignored("a/tmp/b")
    binary = lambda b: spark.createDataFrame([(bytearray(b),)], "c binary").select(files.is_binary(F.col("c"))).first()[0]
    assert binary(b"a\0b") and binary(b"\x01\x02\x03a") and not binary(b"plain\n\ttext") and not binary(b"")


def test_error_log_with_ticks_and_bare_deletion(spark):
    text = "# Log\n\n### 2025-01-02T03:04 — `grep`\n\n**Source:** Auto-captured\n**Status:** `resolved`\n\n**Error:** no such file\n\n### 2025-01-02T03:05 — `edit`\n**Error:** no match\n### broken\n"
    rows = logs.error_entries(spark.createDataFrame([(1, text)], "id int, content string")).orderBy("n").collect()
    assert [(r.tool, r.error, r.status, r.source) for r in rows] == [("grep", "no such file", "resolved", "auto"), ("edit", "no match", "unresolved", "agent")]
    judge = lambda c: spark.range(1).select(logs.judge_command(F.lit(c))).first()[0].blocked
    assert judge("rm /") and judge("rm -r -f /*") and judge("rm ~") and not judge("rm -rf /tmp/x/y.txt") and not judge("rm ./a")
