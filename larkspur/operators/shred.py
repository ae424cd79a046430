"""Adjacency-table shredding of deeply nested, irregular JSON records.

``shred`` turns each record into rows (rec_id, node, parent, label, ordinal, kind, scalar, body_at): one row for each
object, array and scalar below the root, at any depth, inside and outside of the body, told by the JSON itself. A
node is named by its way from the root; ``body_at`` is where the part of the name below the body begins, null outside.
``plan_entities`` joins object nodes with their scalar children on (rec_id, node) and pivots them into flat entity
rows; the join and the pivot share one grouping, so a record is parsed once and shuffled once.

A ``Shape`` only helps to read irregular records: which labels usually hold arrays, which objects, and by which labels
a body is told from its envelope. Whatever it doesn't name is shredded as it stands. Defined results:

* null, blank or invalid JSON gives no rows, JSON without a body no entities;
* key case style (camelCase, snake_case, kebab-case) is ignored; of keys that become equal the later are named ``~2``...;
* where an array is usual, a lone element is position 1 and an object with numeric keys gives positions; where an
  object is usual, each object of a list is read;
* JSON text in place of an array, an object, the body or the whole record is read as if it stood there;
* null elements give no row and keep their position; null members give none; an empty array or object is a node;
* every body is read, also several in one envelope; a body inside a body is part of it;
* repeated records give their nodes once; nesting of any depth is read (an iterative parser takes over
  where the C parser's recursion ends); extra columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import spread

ADJACENCY = "rec_id bigint, node string, parent string, label string, ordinal int, kind string, scalar string, body_at int"
ROWS_PER_BATCH, CHARS_PER_BATCH = 50_000, 32_000_000


@dataclass(frozen=True)
class Shape:
    """arrays and objects: labels (lower case, without separators) that usually hold such; body: labels of which one marks a body."""

    arrays: frozenset[str]
    objects: frozenset[str]
    body: frozenset[str]


PLAN = Shape(
    arrays=frozenset({"tasks", "subtasks", "findings", "decisions", "files", "checkpoints"}),
    objects=frozenset({"context", "aggregated"}),
    body=frozenset({"tasks", "checkpoints", "planid"}),
)

_LABELS: dict[str, str] = {}
_TOKEN = re.compile(r'\s*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))')


def label_of(key: str) -> str:
    """A key without case style: subTasks, sub_tasks and sub-tasks are one."""
    got = _LABELS.get(key)
    if got is None:
        got = re.sub(r"[\W_]", "", key.lower()) or "_"
        if len(_LABELS) < 10_000:
            _LABELS[key] = got
    return got


def _no_constant(name: str):
    raise ValueError(name)


_decode = json.JSONDecoder(parse_constant=_no_constant).decode


def _deep(text: str):
    """JSON without recursion, for nesting beyond the C parser's limit."""
    at, stack, wants, done, result = 0, [], "value", False, None
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or done:
            raise ValueError(at)
        at = m.end()
        sign, string, other = m.groups()
        if sign in ("{", "["):
            if wants not in ("value", "first"):
                raise ValueError(at)
            stack.append([{} if sign == "{" else [], None])
            wants = "key0" if sign == "{" else "first"
            continue
        if sign in ("}", "]"):
            if not stack or wants not in (("key0", "after") if sign == "}" else ("first", "after")) or isinstance(stack[-1][0], dict) != (sign == "}"):
                raise ValueError(at)
            value = stack.pop()[0]
        elif sign == ",":
            if wants != "after" or not stack:
                raise ValueError(at)
            wants = "key" if isinstance(stack[-1][0], dict) else "value"
            continue
        elif sign == ":":
            if wants != "colon":
                raise ValueError(at)
            wants = "value"
            continue
        elif string is not None and wants in ("key0", "key"):
            stack[-1][1], wants = _decode(string), "colon"
            continue
        else:
            if wants not in ("value", "first"):
                raise ValueError(at)
            value = _decode(string or other)
        if not stack:
            done, result = True, value
        elif isinstance(stack[-1][0], dict):
            stack[-1][0][stack[-1][1]] = value
        else:
            stack[-1][0].append(value)
        wants = "after"
    if not done:
        raise ValueError(at)
    return result


def parse_json(text: str):
    """The value of strictly valid JSON text; ValueError otherwise."""
    try:
        return _decode(text)
    except RecursionError:
        return _deep(text)


def _as_text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value) if not isinstance(value, (dict, list)) else None


def _unquoted(value, rounds: int = 4):
    """Reads JSON text in place of an object or an array; other text stays as it is."""
    while rounds and isinstance(value, str) and value.lstrip()[:1] in ('{', '[', '"', "n"):
        try:
            value = parse_json(value)
        except ValueError:
            break
        rounds -= 1
    return value


def _elements(value) -> list[tuple[int, object]]:
    """(position, element) of what stands where an array is usual."""
    value = _unquoted(value)
    if value is None:
        return []
    if isinstance(value, list):
        return [(i, x) for i, x in enumerate(value, 1) if x is not None]
    if isinstance(value, dict):
        if not value:
            return []
        if all(k.isascii() and k.isdigit() for k in value):
            return sorted((int(k), x) for k, x in value.items() if x is not None) if len({int(k) for k in value}) == len(value) else [(i, x) for i, x in enumerate(value.values(), 1) if x is not None]
    return [(1, value)]


def _within(path: str, value, shape: Shape, body_at: int | None) -> Iterator[tuple[str, str, int, object, object]]:
    """(node, label, ordinal, value, elements) of what stands directly in an object or a list of elements.

    elements: the (position, element) pairs of a value that is, or stands for, an array; null otherwise.
    """
    prefix = path + "." if path else ""
    met: dict[str, int] = {}
    for key, x in value.items():
        if x is None:
            continue
        label = label_of(key)
        met[label] = n = met.get(label, 0) + 1
        elements = None
        if body_at is None or label in shape.objects:
            read = _unquoted(x)
            x = read if isinstance(read, (dict, list)) else x
        elif label in shape.arrays:
            elements = _elements(x)
        if elements is None and isinstance(x, list):
            elements = [(i, y) for i, y in enumerate(x, 1) if y is not None]
        yield prefix + label + (f"~{n}" if n > 1 else ""), label, 1, x, elements


def adjacency(raw: str | None, shape: Shape) -> Iterator[tuple]:
    """(node, parent, label, ordinal, kind, scalar, body_at) of one record, parents before children."""
    if raw is None or not raw.strip():
        return
    try:
        root = _unquoted(parse_json(raw))
    except ValueError:
        return
    elements = [(i, x) for i, x in enumerate(root, 1) if x is not None] if isinstance(root, list) else None
    stack: list[tuple] = [("", "", root, elements, None)]
    while stack:
        path, label, value, elements, body_at = stack.pop()
        if elements is not None:
            reads = body_at is None or label in shape.arrays
            below = []
            for i, x in elements:
                if reads and isinstance(x, str) and (body_at is None or x.lstrip()[:1] == "{"):
                    read = _unquoted(x)
                    x = read if isinstance(read, dict if body_at is not None else (dict, list)) else x
                below.append((f"{path}[{i}]", label, i, x, [(k, y) for k, y in enumerate(x, 1) if y is not None] if isinstance(x, list) else None))
        elif isinstance(value, dict):
            if body_at is None and not shape.body.isdisjoint(map(label_of, value)):
                body_at = len(path) + 1 if path else 0
            below = _within(path, value, shape, body_at)
        else:
            return  # the whole record is a scalar
        for node, name, ordinal, x, inner in below:
            if inner is not None:
                yield node, path, name, ordinal, "array", None, body_at
                stack.append((node, name, x, inner, body_at))
            elif isinstance(x, dict):
                yield node, path, name, ordinal, "object", None, body_at
                stack.append((node, name, x, None, body_at))
            else:
                yield node, path, name, ordinal, "scalar", _as_text(x), body_at


def shred(df: DataFrame, id_col: str = "rec_id", raw_col: str = "raw", shape: Shape = PLAN) -> DataFrame:
    """The adjacency table of ``raw_col``; a narrow, streaming operation without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            cols = list(zip(*rows))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32())
            names = ("rec_id", "node", "parent", "label", "ordinal", "kind", "scalar", "body_at")
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=list(names))

        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for rec, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for x in adjacency(raw, shape):
                    rows.append((rec, *x))
                    held += len(x[0])
                    if held >= CHARS_PER_BATCH or len(rows) >= ROWS_PER_BATCH:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    return spread(df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(raw_col).cast("string").alias("raw"))).mapInArrow(run, ADJACENCY)


#: entity by the labels on the way to its node, subtasks left out
_PLAN_ENTITIES = {
    "tasks": "task", "tasks.context.findings": "finding", "tasks.context.decisions": "decision", "tasks.context.files": "file",
    "checkpoints": "checkpoint", "checkpoints.aggregated.findings": "agg_finding", "checkpoints.aggregated.decisions": "agg_decision", "checkpoints.aggregated.files": "agg_file",
}
PLAN_ATTRIBUTES = ("id", "title", "status", "notes", "checkpoint", "taskid", "completedat", "summary")


def plan_entities(adjacent: DataFrame) -> DataFrame:
    """Flat entity rows of shredded plans: rec_id, entity, path, parent, text and the pivoted scalars.

    Object nodes meet their scalar children on the key (rec_id, node): a scalar that is no entity itself
    carries its parent's key, so one grouping is both the outer join and the pivot.
    """
    inside = adjacent.where("body_at is not null")
    below = F.expr("substring(node, body_at + 1)")
    below = F.when(F.contains("node", F.lit("~")), F.regexp_replace(below, r"~\d+", "")).otherwise(below)
    # one pass over the node, then a look-up; no repeated groups: their matching is recursive and nesting has no bound
    way = F.regexp_replace(below, r"(?:(?<=\])\.subtasks)?\[\d+\]", "")
    listed = F.col("node").endswith("]") & ~F.contains("node", F.lit("]["))  # arrays themselves and lists in lists are none
    entity = F.when(listed, F.create_map(*[F.lit(x) for pair in _PLAN_ENTITIES.items() for x in pair])[way])
    attribute = (F.col("kind") == "scalar") & F.col("parent").endswith("]") & F.col("label").isin(*PLAN_ATTRIBUTES)
    keyed = inside.select("rec_id", "node", "parent", "label", "scalar", "body_at", entity.alias("entity"), attribute.alias("attribute")).where("entity is not null or attribute")
    keyed = keyed.withColumn("key", F.when(F.col("entity").isNull(), F.col("parent")).otherwise(F.col("node")))
    is_attribute = F.col("entity").isNull()
    grouped = keyed.groupBy("rec_id", "key").agg(
        F.max("entity").alias("entity"),
        F.max("body_at").alias("body_at"),
        F.max(F.when(~is_attribute, F.col("scalar"))).alias("text"),
        *(F.max(F.when(is_attribute & (F.col("label") == a), F.col("scalar"))).alias(a) for a in PLAN_ATTRIBUTES),
    ).where("entity is not null")
    below = F.expr("substring(key, body_at + 1)")
    below = F.when(F.contains("key", F.lit("~")), F.regexp_replace(below, r"~\d+", "")).otherwise(below)
    flat = F.regexp_replace(below, r"^checkpoints\[(\d+)\]", "c$1")
    flat = F.regexp_replace(flat, r"(?:\.context|\.aggregated)(?:\[\d+\])?\.(?:findings|decisions|files)\[(\d+)\]$", "/$1")
    flat = F.regexp_replace(flat, r"(?:sub)?tasks\[(\d+)\]", "$1")
    path = grouped.withColumn("path", flat)
    parent = (
        F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^([^/]*)/", 1))
        .when(F.col("entity") == "task", F.regexp_extract("path", r"^(.*)\.\d+$", 1))
        .otherwise(F.lit(""))
    )
    return path.select("rec_id", "entity", "path", parent.alias("parent"), "text", *PLAN_ATTRIBUTES)


def plan_nodes(plan_records: DataFrame) -> DataFrame:
    """(rec_id, entity, path, parent) of every node of every plan record."""
    return plan_entities(shred(plan_records)).select("rec_id", "entity", "path", "parent")
