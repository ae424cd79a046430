"""Queries take every row that their operator is for."""

import hashlib

import __spark_entry__ as entry
from larkspur.operators import search


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_short_blocks_are_listed(spark, tmp_path):
    d = written(spark, tmp_path, "documents", [(1, "```\n\nx"), (2, "a\n```\n"), (3, None), (4, "y" * 50)], "doc_id bigint, text string")
    assert {tuple(r) for r in entry.queries()["sliding_block_match"](spark, d).collect()} == {("```\n", 2, 2)}


def test_every_query_vector_gets_its_neighbours(spark, tmp_path):
    rows = [(i, [1.0, i / 100], i % 2) for i in range(101)]
    d = written(spark, tmp_path, "embeddings", rows, "vec_id bigint, embedding array<double>, label int")
    got = entry.queries()["knn_topk"](spark, d).collect()
    assert {q: {r.vec_id for r in got if r.q_id == q} for q in (0, 50, 100)} == {0: set(range(1, 11)), 50: {*range(45, 50), *range(51, 56)}, 100: set(range(90, 100))}
    assert len(got) == 30


def test_more_queries_than_a_block(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(60)], "vec_id bigint, embedding array<double>")
    asked = rows.selectExpr("vec_id as q_id", "embedding as q")
    whole = {tuple(r) for r in search.knn(rows, asked, "vec_id", "embedding", 3).collect()}
    monkeypatch.setattr(search, "BLOCK", 7)
    df = search.knn(rows, asked, "vec_id", "embedding", 3)
    assert "CartesianProduct" in df._jdf.queryExecution().toString() and {tuple(r) for r in df.collect()} == whole and len(whole) == 180
    many = spark.range(1001).selectExpr("id as q_id", "array(1.0D, id / 100) as q")
    monkeypatch.undo()
    assert search.knn(rows, many, "vec_id", "embedding", 3).count() == 3003


def test_type_references_of_files(spark, tmp_path):
    rows = [("w", "a.ts", "export interface Shard { n: number }\n"), ("w", "b.ts", "function f(x: Shard): void {\n}\n"), ("v", "c.ts", "function g(x: Shard): void {\n}\n"), ("w", "d.ts", None)]
    d = written(spark, tmp_path, "source_files", rows, "workspace string, file string, content string")
    assert {tuple(r) for r in entry.queries()["typeref_edges"](spark, d).collect()} == {("w/b.ts", "w/a.ts")}


def test_words_of_documents(spark, tmp_path):
    written(spark, tmp_path, "part", [(1, "green lamp")], "p_partkey bigint, p_name string")
    d = written(spark, tmp_path, "documents", [(1, "A lamp, a lamp."), (2, None)], "doc_id bigint, text string")
    assert {tuple(r) for r in entry.queries()["ref_left_join"](spark, d).collect()} == {(1, "lamp"), (1, "A (unresolved)"), (1, "a (unresolved)")}


def test_symbol_names_are_searched(spark, tmp_path):
    d = written(spark, tmp_path, "outline_symbols", [("openShard",), ("Shard",), ("Shard",), ("shards",), ("other",)], "name string")
    assert [r.name for r in entry.queries()["did_you_mean"](spark, d).collect()] == ["Shard", "shards", "openShard"]


def test_short_files_are_edited(spark, tmp_path):
    d = written(spark, tmp_path, "source_files", [(1, "a\nbc\n"), (2, "one line"), (3, ""), (4, None), (5, "first line\nsecond line\nthird")], "file_id bigint, content string")
    got = {r.file_id: r for r in entry.queries()["edited_files"](spark, d).collect()}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert set(got) == {1, 2, 3, 4, 5} and (got[4].strategy, got[4].result) == (None, None)
    assert got[1].result == md5("a\nEDITED\n") and got[5].result == md5("first line\nEDITED\nthird")
    assert got[2].result == md5("one line") and got[3].result == md5("")


def test_every_file_has_a_page(spark, tmp_path):
    d = written(spark, tmp_path, "source_files", [(1, "a\nb\nc"), (2, "\n".join(map(str, range(1, 15)))), (3, None), (4, "x")], "file_id bigint, content string")
    assert {tuple(r) for r in entry.queries()["file_page"](spark, d).collect()} == {(1, 3, "c")} | {(2, i, str(i)) for i in range(3, 13)}
