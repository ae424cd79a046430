"""SQL, for DuckDB, of the queries on nested plan records: a recursive reading of the JSON, apart from the operator."""

from __future__ import annotations


def _label(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def _text(x: str) -> str:
    return f"json_extract_string({x}, '$')"


def _read(x: str, rounds: int = 2) -> str:
    """JSON text in place of a value, read."""
    for _ in range(rounds):
        x = f"(CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({_text(x)}) THEN CAST({_text(x)} AS JSON) ELSE {x} END)"
    return x


def _list(x: str) -> str:
    """What stands where an array is usual: an array, or an object by position."""
    return f"""(CASE json_type({x}) WHEN 'ARRAY' THEN {x} WHEN 'NULL' THEN CAST('[]' AS JSON) WHEN 'OBJECT' THEN
        (CASE WHEN len(json_keys({x})) = 0 THEN CAST('[]' AS JSON) WHEN len(list_filter(json_keys({x}), lambda k: NOT regexp_full_match(k, '[0-9]+'))) = 0 THEN {x} ELSE json_array({x}) END)
        ELSE json_array({x}) END)"""


def _elements(source: str, carried: str, where: str) -> str:
    """Rows (carried..., pos, v) of the elements of the members m of the objects of a relation."""
    return f"""(SELECT {carried}, CAST(e.key AS INT) + CASE WHEN json_type(s.w) = 'ARRAY' THEN 1 ELSE 0 END AS pos,
          CASE WHEN e.type = 'VARCHAR' AND starts_with(ltrim({_text("e.value")}), '{{') THEN {_read("e.value")} ELSE e.value END AS v
        FROM (SELECT *, {_list("u")} AS w FROM (SELECT o.*, m.key AS member, {_read("m.value")} AS u FROM {source} o, json_each(o.v) m WHERE json_type(o.v) = 'OBJECT' AND {where})) s, json_each(s.w) e
        WHERE e.type <> 'NULL')"""


def _objects(source: str, label: str) -> str:
    """(rec_id, path, v): the objects under a label that usually holds one."""
    return f"""(SELECT s.rec_id, s.path, e.value AS v FROM (SELECT o.rec_id, o.path, {_read("m.value")} AS u FROM {source} o, json_each(o.v) m
        WHERE json_type(o.v) = 'OBJECT' AND {_label("m.key")} = '{label}') s, json_each(CASE WHEN json_type(s.u) = 'ARRAY' THEN s.u ELSE json_array(s.u) END) e WHERE e.type = 'OBJECT')"""


_BODY = f"len(list_filter(json_keys(v), lambda k: {_label('k')} IN ('tasks', 'checkpoints', 'planid'))) > 0"
_ENTRY = "CASE {l} WHEN 'findings' THEN 'finding' WHEN 'decisions' THEN 'decision' ELSE 'file' END".format(l=_label("member"))
_LISTS = f"{_label('m.key')} IN ('findings', 'decisions', 'files')"

ENTITIES = f"""WITH RECURSIVE raws AS (SELECT DISTINCT rec_id, raw FROM plan_records WHERE raw IS NOT NULL AND json_valid(raw)),
    env AS (SELECT rec_id, {_read("CAST(raw AS JSON)")} AS v FROM raws
      UNION ALL SELECT rec_id, v FROM (SELECT p.rec_id, {_read("m.value")} AS v FROM (SELECT * FROM env WHERE json_type(v) = 'ARRAY' OR (json_type(v) = 'OBJECT' AND NOT {_BODY})) p, json_each(p.v) m) WHERE json_type(v) IN ('OBJECT', 'ARRAY')),
    bodies AS (SELECT rec_id, '' AS path, v FROM env WHERE json_type(v) = 'OBJECT' AND {_BODY}),
    tasks AS (SELECT rec_id, CAST(pos AS VARCHAR) AS path, '' AS parent, v FROM {_elements("bodies", "s.rec_id, s.path", _label("m.key") + " = 'tasks'")}
      UNION ALL SELECT rec_id, path || '.' || pos, path, v FROM {_elements("tasks", "s.rec_id, s.path", _label("m.key") + " = 'subtasks'")}),
    saved AS (SELECT rec_id, 'c' || pos AS path, v FROM {_elements("bodies", "s.rec_id, s.path", _label("m.key") + " = 'checkpoints'")}),
    contexts AS {_objects("tasks", "context")},
    totals AS {_objects("saved", "aggregated")},
    ent AS (SELECT rec_id, 'task' AS entity, path, parent, v FROM tasks
      UNION ALL SELECT rec_id, 'checkpoint', path, '', v FROM saved
      UNION ALL SELECT rec_id, {_ENTRY}, path || '/' || pos, path, v FROM {_elements("contexts", "s.rec_id, s.path, s.member", _LISTS)}
      UNION ALL SELECT rec_id, 'agg_' || {_ENTRY}, path || '/' || pos, path, v FROM {_elements("totals", "s.rec_id, s.path, s.member", _LISTS)}),
    scalars AS (SELECT e.rec_id, e.entity, e.path, {_label("m.key")} AS label, CASE WHEN m.type = 'VARCHAR' THEN {_text("m.value")} ELSE CAST(m.value AS VARCHAR) END AS x
      FROM ent e, json_each(e.v) m WHERE json_type(e.v) = 'OBJECT' AND m.type NOT IN ('OBJECT', 'ARRAY', 'NULL')),
    t AS (SELECT e.rec_id AS plan_id, e.path, e.parent, max(x) FILTER (label = 'status') AS status, coalesce(max(x) FILTER (label = 'checkpoint') = 'true', false) AS due
      FROM ent e LEFT JOIN scalars s ON e.rec_id = s.rec_id AND e.path = s.path AND s.entity = 'task' WHERE e.entity = 'task' GROUP BY ALL)"""
_TEXT = f"CASE WHEN json_type(e.v) IN ('OBJECT', 'ARRAY') THEN NULL WHEN json_type(e.v) = 'VARCHAR' THEN {_text('e.v')} ELSE CAST(e.v AS VARCHAR) END"
_ATTRIBUTES = ("id", "title", "status", "notes", "checkpoint", "taskid", "completedat", "summary")
_BELOW = "b.plan_id = a.plan_id AND starts_with(b.path, a.path || '.')"
_ENDED = "IN ('completed', 'cancelled', 'failed')"
#: no ended task stands strictly between a and b
_FREE = f"NOT EXISTS (SELECT 1 FROM t m WHERE m.plan_id = a.plan_id AND starts_with(m.path, a.path || '.') AND starts_with(b.path, m.path || '.') AND coalesce(m.status {_ENDED}, false))"

SQL: dict[str, str] = {
    "p1_found": f"{ENTITIES} SELECT rec_id, entity, path, parent FROM ent",
    "p1_entities": f"""{ENTITIES} SELECT e.rec_id, e.entity, e.path, e.parent, {_TEXT} AS text, {", ".join(f"max(x) FILTER (label = '{a}') AS {a}" for a in _ATTRIBUTES)}
        FROM ent e LEFT JOIN scalars s ON e.rec_id = s.rec_id AND e.path = s.path AND e.entity = s.entity GROUP BY e.rec_id, e.entity, e.path, e.parent, e.v""",
    "p1_progress": f"{ENTITIES} SELECT plan_id, count(*) AS tasks, count(*) FILTER (status = 'completed') AS completed, round(count(*) FILTER (status = 'completed') / count(*), 4) AS progress FROM t GROUP BY plan_id",
    "p1_current": f"""{ENTITIES} SELECT plan_id, path FROM t WHERE status IN ('in_progress', 'pending')
        QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY status = 'pending', CAST(string_split(path, '.') AS INT[])) = 1""",
    "p1_cancelled": f"{ENTITIES} SELECT plan_id, path, CASE WHEN (path = '1' OR starts_with(path, '1.')) AND status <> 'completed' THEN 'cancelled' ELSE status END AS status FROM t",
    "p1_pending_checkpoints": f"""{ENTITIES} SELECT plan_id, path FROM t a WHERE due AND EXISTS (SELECT 1 FROM t k WHERE k.plan_id = a.plan_id AND k.parent = a.path)
        AND NOT EXISTS (SELECT 1 FROM t k WHERE k.plan_id = a.plan_id AND k.parent = a.path AND coalesce(k.status NOT IN ('completed', 'cancelled'), true))
        AND NOT EXISTS (SELECT 1 FROM scalars s WHERE s.rec_id = a.plan_id AND s.entity = 'checkpoint' AND s.label = 'taskid' AND s.x = a.path)""",
    "p1_context": f"""{ENTITIES}, held AS (SELECT e.rec_id AS plan_id, e.entity, {_TEXT} AS text, e.path FROM ent e WHERE e.entity IN ('finding', 'decision', 'file')
          AND NOT EXISTS (SELECT 1 FROM t u WHERE u.plan_id = e.rec_id AND (u.path = e.parent OR starts_with(e.parent, u.path || '.')) AND coalesce(u.status <> 'completed', true)))
        SELECT plan_id, entity, text, path FROM held WHERE entity <> 'file' UNION ALL SELECT plan_id, entity, text, min(path) FROM held WHERE entity = 'file' GROUP BY ALL""",
    "p1_promoted": f"""{ENTITIES}, open AS (SELECT * FROM t WHERE NOT coalesce(status {_ENDED}, false) AND EXISTS (SELECT 1 FROM t k WHERE k.plan_id = t.plan_id AND k.parent = t.path)),
        near AS (SELECT a.plan_id, a.path, bool_or(NOT coalesce(b.status {_ENDED}, false)) AS waits, bool_or(coalesce(b.status = 'failed', false)) AS bad
          FROM open a JOIN t b ON {_BELOW} WHERE {_FREE} AND (coalesce(b.status {_ENDED}, false) OR NOT EXISTS (SELECT 1 FROM t k WHERE k.plan_id = b.plan_id AND k.parent = b.path)) GROUP BY ALL)
        SELECT t.plan_id, t.path, CASE WHEN n.waits = false THEN CASE WHEN bad THEN 'failed' ELSE 'completed' END ELSE status END AS status FROM t LEFT JOIN near n ON n.plan_id = t.plan_id AND n.path = t.path""",
}
