import json

import pytest

from larkspur.operators import shred as S

PLAN = {
    "planId": "p", "goal": "g",
    "tasks": [
        {"id": "9", "title": "a", "status": "pending", "context": {"findings": ["x", None, "y"], "decisions": [], "files": None}, "subtasks": [None, {"id": "1.2", "title": "b", "subtasks": [{"id": "1.2.1"}]}]},
        {"id": "2"},
    ],
    "checkpoints": [{"taskId": "1", "aggregated": {"findings": ["f"], "keyFiles": ["k"]}}],
    "history": [{"event": "e"}],
}
ROWS = {
    ("task", "1", ""), ("task", "2", ""), ("task", "1.2", "1"), ("task", "1.2.1", "1.2"), ("finding", "1/1", "1"), ("finding", "1/3", "1"),
    ("checkpoint", "c1", ""), ("agg_finding", "c1/1", "c1"),
}


def nodes(spark, *raws, ids=None):
    df = spark.createDataFrame([(ids[i] if ids else i, r, "clash", 1) for i, r in enumerate(raws)], "rec_id bigint, raw string, node string, key int")
    return [tuple(r) for r in S.plan_nodes(df).collect()]


def snake(x):
    if isinstance(x, dict):
        return {"".join("_" + c.lower() if c.isupper() else c for c in k): snake(v) for k, v in x.items()}
    return [snake(y) for y in x] if isinstance(x, list) else x


def test_shapes_give_the_rows_of_the_regular_one(spark):
    positional = json.loads(json.dumps(PLAN))
    positional["tasks"] = {"1": PLAN["tasks"][0] | {"subtasks": {"2": PLAN["tasks"][0]["subtasks"][1]}, "context": json.dumps(PLAN["tasks"][0]["context"])}, "2": {"id": "2"}}
    positional["checkpoints"] = PLAN["checkpoints"][0] | {"aggregated": {"findings": "f"}}
    shapes = [PLAN, snake(PLAN), positional, [PLAN], {"plan": PLAN}, {"version": 2, "data": {"plan": PLAN}}, {"type": "plan", "payload": json.dumps(PLAN)}]
    raws = [json.dumps(x) for x in shapes] + [json.dumps(json.dumps(PLAN))]
    got = nodes(spark, *raws)
    for i in range(len(raws)):
        assert {r[1:] for r in got if r[0] == i} == ROWS, i
    assert len(got) == len(raws) * len(ROWS)


def test_what_gives_nothing(spark):
    assert nodes(spark, None, "", "  ", "{", "null", "[]", "3", '{"a": 1}', '{"tasks": []} x', '{"tasks": NaN}', '{"tasks": null}') == []
    assert S.plan_nodes(spark.createDataFrame([], "rec_id bigint, raw string")).count() == 0


def test_repeated_rows_count_once(spark):
    assert len(nodes(spark, json.dumps(PLAN), json.dumps(PLAN), ids=[7, 7])) == len(ROWS)


def test_any_depth(spark):
    deep = '{"tasks": [{"id": "1"' + ', "subtasks": [{"id": "1"' * 3000 + "}]" * 3000 + "}]}"
    got = nodes(spark, deep)
    assert len(got) == 3001 and max(len(r[2].split(".")) for r in got) == 3001


@pytest.mark.parametrize("text", ['{"a": [1, 2.5, -3e2, "x\\n", true, false, null, {}, []]}', "[]", '"s"', "12"])
def test_iterative_parser_agrees(text):
    assert S._deep(text) == json.loads(text)


@pytest.mark.parametrize("text", ["{", "[1,]", '{"a" 1}', "[1 2]", "{1: 2}", "", "[1]]", '{"a":}', "tru"])
def test_iterative_parser_rejects(text):
    with pytest.raises(ValueError):
        S._deep(text)


def test_attributes_are_pivoted(spark):
    df = spark.createDataFrame([(1, json.dumps(PLAN))], "rec_id bigint, raw string")
    rows = {(r.entity, r.path): r for r in S.plan_entities(S.shred(df)).collect()}
    assert rows["task", "1"].title == "a" and rows["task", "1"].status == "pending" and rows["finding", "1/3"].text == "y" and rows["checkpoint", "c1"].taskid == "1"


def table_of(*raws):
    return [{r[0]: (r[1], r[2], r[3], r[4], r[5]) for r in S.adjacency(json.dumps(x), S.PLAN)} for x in raws]


def test_nothing_unlisted_is_lost():
    plan = {"planId": "p", "tasks": [{"meta": {"a": 1, "deep": {"b": [1, {"c": None, "d": "x"}]}}, "links": [{"k": 1}, None, {"k": 2}], "empty": [], "none": {}}], "history": [{"event": "e"}]}
    (got,) = table_of(plan)
    assert got["tasks[1].meta"][3] == "object" and got["tasks[1].meta.a"] == ("tasks[1].meta", "a", 1, "scalar", "1")
    assert got["tasks[1].meta.deep.b[2].d"] == ("tasks[1].meta.deep.b[2]", "d", 1, "scalar", "x") and got["tasks[1].meta.deep.b[1]"][4] == "1"
    assert got["tasks[1].links[1].k"][4] == "1" and got["tasks[1].links[3].k"][4] == "2" and "tasks[1].links[2]" not in got
    assert got["tasks[1].empty"][3] == "array" and got["tasks[1].none"][3] == "object" and got["history[1].event"][4] == "e"
    assert all(parent == "" or parent in got for parent, *_ in got.values())


def test_every_element_and_every_body_is_read(spark):
    two = {"tasks": [{"context": [{"findings": ["a"]}, {"findings": ["b", "c"]}]}]}
    envelope = {"kind": "pair", "first": {"tasks": [{"title": "x"}]}, "second": {"tasks": [{"title": "y"}, {"title": "z"}]}}
    df = spark.createDataFrame([(1, json.dumps(two)), (2, json.dumps(envelope))], "rec_id bigint, raw string")
    rows = S.plan_entities(S.shred(df)).collect()
    assert sorted((r.path, r.text) for r in rows if r.entity == "finding") == [("1/1", "a"), ("1/1", "b"), ("1/2", "c")]
    assert sorted((r.path, r.title) for r in rows if r.rec_id == 2) == [("1", "x"), ("1", "y"), ("2", "z")]
    (got,) = table_of(envelope)
    assert got["kind"][4] == "pair" and got["second.tasks[2].title"][4] == "z"


def test_equal_labels_keep_both():
    (got,) = table_of({"tasks": [{"my_key": 1, "myKey": 2, "subTasks": [{"id": "a"}], "sub_tasks": [{"id": "b"}]}]})
    assert got["tasks[1].mykey"][4] == "1" and got["tasks[1].mykey~2"][4] == "2" and got["tasks[1].subtasks~2[1].id"][4] == "b"
