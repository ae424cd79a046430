"""The same results in SQL, for DuckDB."""

from __future__ import annotations

from . import plansql

_KNN = """
    SELECT q.vec_id AS q_id, e.vec_id, round(1 - (1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) / 2, 3) AS score
    FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) q WHERE e.vec_id <> q.vec_id {scope}
    QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) <= 10"""
_LINES = "(SELECT {keys}, unnest(string_split(replace({text}, chr(13), ''), chr(10))) AS line, generate_subscripts(string_split(replace({text}, chr(13), ''), chr(10)), 1) AS line_no FROM {table})"
_DOC_LINES = _LINES.format(keys="doc_id", text="text", table="documents")
_CODE_LINES = _LINES.format(keys="file_id, file", text="content", table="source_files")
_VISITS = """
    p AS (SELECT o_custkey AS cust, l_orderkey, l_linenumber, l_shipdate::DATE - DATE '1970-01-01' AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    o AS (SELECT o_custkey AS cust, o_orderkey, o_orderdate::DATE - DATE '1970-01-01' AS s FROM orders)"""
_DIR = "CASE WHEN contains(file, '/') THEN regexp_extract(file, '^(.*)/[^/]*$', 1) ELSE '' END"
_ROOTS = f"r AS (SELECT DISTINCT {_DIR} AS root FROM source_files WHERE symbols >= 5 AND {_DIR} <> ''), f AS (SELECT file_id, file FROM source_files)"
_GRAPH = "g AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)"
_DEGREE = f"{_GRAPH}, n AS (SELECT dst, count(*) AS c FROM g GROUP BY dst), d AS (SELECT 'p' || p_partkey AS file, p_size, coalesce(c, 0) AS in_degree FROM part LEFT JOIN n ON dst = 'p' || p_partkey)"
_IDS = "ids AS (SELECT DISTINCT '/ws/' || workspace || '/' || file || '::' || name || '::' || start_line AS id FROM outline_symbols WHERE workspace IS NOT NULL AND file IS NOT NULL AND name IS NOT NULL AND start_line IS NOT NULL)"
_DIAG = """g AS (SELECT event_id, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS severity, 'u' || user_id AS file, event_id AS line,
    CASE WHEN user_id % 5 > 0 THEN 'r' || (user_id % 5) END AS root FROM events)"""
_COUNTS = "count(*) FILTER (severity = 1) AS errors, count(*) FILTER (severity = 2) AS warnings, count(*) FILTER (severity = 3) AS infos, count(*) FILTER (severity = 4) AS hints, count(DISTINCT file) AS files, count(*) AS total"
_OUT = "o AS (SELECT symbol_id, any_value(file_id) AS file_id, any_value(name) AS name, any_value(start_line) AS start_line, any_value(end_line) AS end_line FROM outline_symbols GROUP BY symbol_id)"
_LANGUAGE = "CASE lower(regexp_extract(file, '\\.([^./]+)$', 1)) WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' END"

SQL: dict[str, str] = {
    "knn_topk": _KNN.format(scope=""),
    "knn_scoped": _KNN.format(scope="AND e.label = 3"),
    "grep_content": f"SELECT doc_id, line_no, line FROM {_DOC_LINES} WHERE regexp_matches(line, '(?i)the')",
    "grep_files": f"SELECT DISTINCT doc_id FROM {_DOC_LINES} WHERE contains(line, 'lease')",
    "grep_count": f"SELECT doc_id, count(*) AS matches FROM {_DOC_LINES} WHERE regexp_matches(line, '(?i)the') GROUP BY doc_id",
    "grep_code_glob": f"SELECT file_id, line_no FROM {_CODE_LINES} WHERE ends_with(file, '.py') AND contains(line, 'return ')",
    "text_search": f"""
        WITH h AS (SELECT DISTINCT file_id, line_no FROM {_CODE_LINES} WHERE regexp_matches(line, 'log\\.')),
        s AS (SELECT DISTINCT file_id, name, start_line, end_line FROM outline_symbols),
        i AS (SELECT h.file_id, line_no, name FROM h JOIN s ON h.file_id = s.file_id AND line_no BETWEEN start_line AND end_line
            QUALIFY row_number() OVER (PARTITION BY h.file_id, line_no ORDER BY start_line, name) = 1),
        r AS (SELECT * FROM h ANTI JOIN i USING (file_id, line_no)),
        a AS (SELECT r.file_id, line_no, arg_max(name, (start_line, name)) AS name FROM r JOIN s ON r.file_id = s.file_id AND start_line <= line_no GROUP BY ALL),
        u AS (SELECT file_id, line_no, name FROM i UNION ALL SELECT r.file_id, r.line_no, a.name FROM r LEFT JOIN a USING (file_id, line_no))
        SELECT file_id, line_no, name FROM u QUALIFY row_number() OVER (PARTITION BY file_id, coalesce(name, 'line ' || line_no) ORDER BY line_no) = 1""",
    "interval_first": f"""WITH {_VISITS} SELECT l_orderkey, l_linenumber, o_orderkey FROM p JOIN o ON p.cust = o.cust AND day BETWEEN s AND s + 30
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, day ORDER BY s, o_orderkey) = 1""",
    "interval_innermost": f"""WITH {_VISITS}, b AS (SELECT *, s + 30 AS e FROM o UNION ALL SELECT *, s + 90 AS e FROM o)
        SELECT l_orderkey, l_linenumber, o_orderkey, e - s AS span FROM p JOIN b ON p.cust = b.cust AND day BETWEEN s AND e
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, day ORDER BY e - s, s, o_orderkey) = 1""",
    "asof_backward": """SELECT p.event_id, arg_max(v.event_id, (v.ts, v.event_id)) AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
        LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND v.ts <= p.ts GROUP BY p.event_id""",
    "longest_prefix": f"""WITH {_ROOTS} SELECT file_id, root FROM f JOIN r ON file = root OR starts_with(file, root || '/')
        QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY length(root) DESC, root) = 1""",
    "all_prefixes": f"WITH {_ROOTS} SELECT file_id, count(*) AS roots FROM f JOIN r ON file = root OR starts_with(file, root || '/') GROUP BY file_id",
    "first_candidate": """WITH k AS (SELECT p_type AS target FROM part WHERE p_size > 45 UNION SELECT p_brand FROM part WHERE p_size > 40),
        c AS (SELECT p_partkey, p_type AS target, 0 AS candidate FROM part UNION ALL SELECT p_partkey, p_brand, 1 FROM part)
        SELECT p_partkey, target, candidate FROM c SEMI JOIN k USING (target) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY candidate, target) = 1""",
    "ref_left_join": """WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) AS word FROM documents), k AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)
        SELECT doc_id, CASE WHEN k.word IS NULL THEN w.word || ' (unresolved)' ELSE w.word END AS word FROM w LEFT JOIN k ON w.word = k.word WHERE w.word <> ''""",
    "outline_tree": "SELECT r_regionkey, r_name, coalesce(string_agg(n_name, ', ' ORDER BY n_name), '') AS nations, count(n_name) AS n_nations FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY ALL",
    "enclosing_symbol": f"""WITH {_OUT}, c AS (SELECT * FROM o WHERE file_id IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL),
        q AS (SELECT a.symbol_id, b.symbol_id AS parent_id, b.start_line AS s, b.end_line AS e FROM c a JOIN c b ON a.file_id = b.file_id AND b.start_line <= a.start_line AND b.end_line >= a.end_line AND b.end_line - b.start_line > a.end_line - a.start_line
            QUALIFY row_number() OVER (PARTITION BY a.symbol_id ORDER BY b.end_line - b.start_line, b.start_line, b.symbol_id) = 1)
        SELECT c.symbol_id, parent_id FROM c LEFT JOIN q USING (symbol_id)""",
    "anti_embed": f"WITH {_IDS} SELECT id FROM ids WHERE id NOT IN (SELECT id FROM symbol_vectors WHERE id IS NOT NULL)",
    "live_vectors": f"WITH {_IDS} SELECT DISTINCT label, id FROM symbol_vectors WHERE id IN (SELECT id FROM ids)",
    "in_degree": f"WITH {_DEGREE} SELECT file, in_degree FROM d",
    "file_rank": f"""WITH {_DEGREE}, s AS (SELECT file, (in_degree + CASE WHEN p_size > 40 THEN 5.0::DOUBLE ELSE 0 END) * CASE WHEN p_size < 10 THEN 0.3::DOUBLE ELSE 1 END AS score FROM d)
        SELECT file, round(CASE WHEN max(score) OVER () > 0 THEN score / max(score) OVER () ELSE 0 END, 6) AS rank FROM s""",
    "edge_count": f"WITH {_GRAPH} SELECT count(*) AS edges FROM g",
    "graph_nodes": f"WITH {_GRAPH} SELECT src AS file FROM g UNION SELECT dst FROM g",
    "snapshot_diff": """WITH o AS (SELECT doc_id, n_chars FROM documents),
        n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM o WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id + 10000000, n_chars FROM o WHERE doc_id % 11 = 0)
        SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.n_chars IS NOT DISTINCT FROM n.n_chars THEN 'unchanged' ELSE 'updated' END AS change
        FROM o FULL OUTER JOIN n ON o.doc_id = n.doc_id""",
    "upsert_latest": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "newest_files": "SELECT workspace, file, file_id FROM source_files QUALIFY row_number() OVER (PARTITION BY workspace, file ORDER BY indexed_at DESC NULLS LAST, file_id DESC) = 1",
    "index_summary": f"""WITH {_OUT}, c AS (SELECT file_id, count(*) AS n, max(end_line) AS e FROM o GROUP BY file_id)
        SELECT file_id AS file, coalesce(lines, e, 0) AS lines, coalesce(n, 0) AS symbols, round(coalesce(rank, 0), 6) AS rank,
            coalesce(array_to_string(list_sort(list_distinct(imports)), ','), '') AS imports, coalesce(array_to_string(list_sort(list_distinct(exports)), ','), '') AS exports
        FROM (SELECT file_id, lines, rank, imports, exports FROM source_files) FULL OUTER JOIN c USING (file_id)""",
    "lang_stats": f"SELECT {_LANGUAGE} AS language, count(DISTINCT file) AS files, count(*) AS symbols FROM outline_symbols GROUP BY 1",
    "dir_summary": "SELECT CASE WHEN contains(file, '/') THEN regexp_extract(file, '^/*([^/]+)/', 1) ELSE '.' END AS directory, count(*) AS files, sum(coalesce(symbols, 0))::BIGINT AS symbols, sum(coalesce(lines, 0))::BIGINT AS lines FROM source_files GROUP BY 1",
    "symbol_lookup": "SELECT DISTINCT symbol_id, name FROM outline_symbols WHERE contains(lower(name), 'shard')",
    "resolver": """WITH o AS (SELECT DISTINCT symbol_id, name, file, start_line, end_line FROM outline_symbols),
        t AS (SELECT symbol_id, CASE WHEN name = 'Shard' THEN 1 WHEN ends_with(name, '.Shard') THEN 2 WHEN contains(lower(name), 'shard') THEN 3 END AS tier FROM o)
        SELECT symbol_id, tier FROM t WHERE tier = (SELECT min(tier) FROM t)""",
    "serialize_text": """SELECT p_partkey, 'part ' || p_name || CASE WHEN contains(p_brand || ': ' || p_type, '(') OR contains(p_brand || ': ' || p_type, ':') THEN ' ' || p_brand || ': ' || p_type ELSE '' END || ' | ' || p_brand AS text,
        p_brand || '::' || p_name || '::' || p_size AS id FROM part""",
    "token_budget_prefix": """WITH d AS (SELECT doc_id, coalesce(lower(trim(source)), '') AS source, n_chars FROM documents WHERE n_chars IS NOT NULL),
        r AS (SELECT doc_id, sum(ceil(n_chars / 4.0)::BIGINT) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM d)
        SELECT doc_id, running FROM r WHERE running <= 20000""",
    "top_files": "SELECT file_id, round(coalesce(rank, 0), 6) AS rank FROM source_files ORDER BY coalesce(rank, 0) DESC, file_id LIMIT (SELECT CASE WHEN count(*) <= 100 THEN count(*) WHEN count(*) <= 500 THEN 200 WHEN count(*) <= 2000 THEN 100 ELSE 50 END FROM source_files)",
    "siblings": f"WITH {_OUT} SELECT symbol_id, lag(name) OVER w AS previous, lead(name) OVER w AS following FROM o WINDOW w AS (PARTITION BY file_id ORDER BY start_line NULLS FIRST, symbol_id)",
    "did_you_mean": "SELECT DISTINCT name FROM outline_symbols WHERE contains(lower(name), 'shard') OR contains('shard', lower(name)) ORDER BY length(name), name LIMIT 3",
    "diag_query": f"WITH {_DIAG} SELECT event_id, severity, file FROM g WHERE severity <= 2 ORDER BY severity, file, line LIMIT 50",
    "diag_summary": f"WITH {_DIAG} SELECT {_COUNTS} FROM g",
    "diag_by_group": f"WITH {_DIAG} SELECT coalesce(root, '(unknown)') AS root, {_COUNTS} FROM g GROUP BY 1",
    "diag_filtered_after_limit": f"WITH {_DIAG}, l AS (SELECT * FROM g WHERE severity <= 3 AND root = 'r1' ORDER BY severity, file, line LIMIT 50) SELECT {_COUNTS} FROM l",
    "run_errors": """WITH r AS (SELECT run_id, any_value(workspace) AS workspace, any_value(errors) AS errors FROM index_runs GROUP BY run_id), w AS (SELECT DISTINCT workspace FROM r),
        e AS (SELECT workspace, unnest(errors) AS e FROM r)
        SELECT w.workspace, count(e.e) AS errors, count(DISTINCT e.e.file) AS files FROM w LEFT JOIN e ON w.workspace = e.workspace GROUP BY w.workspace""",
    "dedup_thinning": """WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
        t AS MATERIALIZED (SELECT event_type, ts, min(n) AS n FROM e GROUP BY ALL),
        j AS MATERIALIZED (SELECT a.event_type, a.n, t.n AS m FROM (SELECT *, ts + INTERVAL 1 HOUR AS due FROM e) a ASOF JOIN t ON a.event_type = t.event_type AND a.due <= t.ts),
        c AS (SELECT event_type, 1::BIGINT AS n FROM e WHERE n = 1 UNION ALL SELECT c.event_type, j.m FROM c JOIN j ON c.event_type = j.event_type AND c.n = j.n)
        SELECT e.event_id, e.event_type FROM c JOIN e ON c.event_type = e.event_type AND c.n = e.n""",
    "debounce_session": "SELECT event_id, event_type FROM (SELECT *, lead(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS f FROM events) WHERE f IS NULL OR f - ts >= INTERVAL 30 MINUTE",
    "tree_rollup": """SELECT n_regionkey AS plan_id, count(*) AS tasks, count(*) FILTER (c_acctbal > 0) AS completed, round(count(*) FILTER (c_acctbal > 0) / count(*), 4) AS progress
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    "snippet3": "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:3], chr(10)) || CASE WHEN len(string_split(text, chr(10))) > 3 THEN chr(10) || '...' ELSE '' END AS snippet FROM documents WHERE text IS NOT NULL",
    "sliding_block_match": f"""WITH b AS (SELECT doc_id, trim(line, ' ') || chr(10) || lead(trim(line, ' ')) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM {_DOC_LINES})
        SELECT block, count(*) AS places, count(DISTINCT doc_id) AS documents FROM b WHERE block IS NOT NULL GROUP BY block HAVING count(*) > 1""",
    "fuzzy_levenshtein": "SELECT a.p_brand, a.p_partkey AS a, b.p_partkey AS b, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey WHERE levenshtein(a.p_name, b.p_name) <= 3",
    "json_props": "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events",
    "text_scalars": """SELECT p_partkey, regexp_replace(substr(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', '') AS slug,
        string_split(p_brand || '.' || p_name, '.')[-1] AS short, ceil(length(p_name) / 4.0)::BIGINT AS tokens, p_name || ' x' AS spaced,
        CASE WHEN p_size * 100 < 1024 THEN (p_size * 100)::VARCHAR || ' B' ELSE printf('%.1f KB', p_size * 100 / 1024.0) END AS size FROM part""",
    "set_operations": """SELECT 'union' AS op, k FROM (SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer) UNION ALL
        SELECT 'except', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL
        SELECT 'intersect', k FROM (SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer)""",
    "file_page": f"SELECT file_id, line_no, line FROM {_CODE_LINES} WHERE line_no BETWEEN 3 AND 12",
    "glob_files": "SELECT file_id, file FROM source_files WHERE regexp_matches(file, '^src/(?:[^/]+/)*[^/]*\\.(?:ts|py)$')",
    "grep_context": f"""WITH l AS (SELECT file_id, line_no, line FROM {_CODE_LINES}), h AS (SELECT file_id, line_no FROM l WHERE regexp_matches(line, 'except|catch')),
        w AS (SELECT DISTINCT file_id, line_no + o AS line_no FROM h, (SELECT unnest([-2, -1, 0, 1, 2]) AS o))
        SELECT l.* FROM l JOIN w USING (file_id, line_no)""",
    "nearest_hit": f"""WITH {_OUT}, l AS (SELECT file_id, line_no, line FROM {_CODE_LINES})
        SELECT symbol_id, line_no FROM o JOIN l ON o.file_id = l.file_id AND line_no BETWEEN start_line - 10 AND start_line + 10 AND contains(line, name)
        QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY abs(line_no - start_line), line_no - start_line) = 1""",
    "last_events": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20",
    "ignore_filter": """SELECT file_id FROM source_files WHERE NOT CASE WHEN regexp_matches(file, '(^|/)node_modules(/|$)') THEN true WHEN regexp_matches(file, '^lib/([^/]+/)*[^/]*\\.ts(/|$)') THEN false
        WHEN regexp_matches(file, '^lib(/|$)') THEN true WHEN regexp_matches(file, '(^|/)[^/]*\\.min\\.js(/|$)') THEN true WHEN regexp_matches(file, '(^|/)dist/') THEN true ELSE false END""",
    "language_map": f"SELECT file_id, {_LANGUAGE} AS language, string_split(file, '/')[-1] AS base, {_DIR} AS directory, lower(regexp_extract(file, '\\.([^./]+)$', 1)) AS ext FROM source_files",
    "class_outlines": """WITH o AS (SELECT symbol_id, any_value(name) AS name, any_value(kind) AS kind, any_value(children) AS children FROM outline_symbols GROUP BY symbol_id),
        x AS (SELECT symbol_id, name, unnest(children) AS ch FROM o WHERE kind = 'class') SELECT symbol_id, concat_ws('.', name, ch.name) AS member, ch.start_line AS start_line FROM x""",
    "member_dependencies": """WITH o AS (SELECT symbol_id, any_value(snippet) AS code, any_value(children) AS children, any_value(kind) AS kind FROM outline_symbols GROUP BY symbol_id HAVING any_value(kind) = 'class'),
        r AS (SELECT DISTINCT symbol_id, unnest(regexp_extract_all(code, '\\b(?:this|self)\\.([A-Za-z_$][\\w$]*)', 1)) AS member FROM o),
        m AS (SELECT symbol_id, c.name AS name, any_value(c.kind) AS kind FROM (SELECT symbol_id, unnest(children) AS c FROM o) GROUP BY symbol_id, c.name)
        SELECT r.symbol_id AS class, CASE WHEN m.name IS NULL THEN r.member || ' (unresolved)' ELSE r.member END AS member, coalesce(m.kind, 'property') AS kind FROM r LEFT JOIN m ON r.symbol_id = m.symbol_id AND r.member = m.name""",
    "shorten_texts": "SELECT doc_id, left(text, 40) AS head, right(text, 40) AS tail FROM documents WHERE text IS NOT NULL",
    "log_summary": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN length(props) > 200 THEN '[' || length(props) || ' chars]' ELSE props END AS input, CASE WHEN length(props) * 30 > 200 THEN '[' || length(props) * 30 || ' chars]' ELSE repeat(props, 30) END AS output FROM events",
    "paged": "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 30 OFFSET 15",
    "maintained": "SELECT file_id, CASE WHEN file_id % 4 = 0 THEN coalesce(lines, 0) + 1 ELSE lines END AS lines FROM (SELECT file_id, any_value(lines) AS lines FROM source_files GROUP BY file_id) WHERE file_id % 9 <> 0",
    "directory_tree": """WITH RECURSIVE f AS (SELECT DISTINCT file FROM source_files), p AS (SELECT file AS path, false AS is_dir FROM f UNION SELECT regexp_extract(path, '^(.*)/[^/]*$', 1), true FROM p WHERE contains(path, '/')),
        n AS (SELECT CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END AS parent, count(*) AS c FROM p GROUP BY 1)
        SELECT path, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END AS parent, is_dir, coalesce(c, 0) AS children FROM p LEFT JOIN n ON n.parent = p.path WHERE len(string_split(path, '/')) <= 2""",
}

_DECLARED = r"\b(?:class|interface|enum|type|function|def|func|fn|struct|trait|const|let|var)\s+\*?([A-Za-z_$][\w$]*)"
SQL |= plansql.SQL | {
    "drift_lookup": f"""WITH o AS (SELECT DISTINCT ON (symbol_id) symbol_id, file_id, name, start_line FROM outline_symbols WHERE regexp_full_match(name, '[A-Za-z_$][\\w$]*') AND start_line IS NOT NULL),
        l AS (SELECT file_id, line_no, line FROM {_CODE_LINES}),
        m AS (SELECT symbol_id, start_line, line_no, abs(line_no - start_line) AS away, list_contains(regexp_extract_all(line, '{_DECLARED}', 1), name) AS declares
          FROM o JOIN l ON o.file_id = l.file_id AND list_contains(regexp_extract_all(line, '[A-Za-z_$][\\w$]*'), name)),
        t AS (SELECT *, CASE WHEN away = 0 THEN 0 WHEN declares AND away <= 20 THEN 1 WHEN declares THEN 2 ELSE 3 END AS tier FROM m)
        SELECT symbol_id, line_no, tier FROM t QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY tier, CASE WHEN tier = 2 THEN 0 ELSE away END, line_no) = 1""",
    "diffstat_lines": f"""WITH x AS (SELECT doc_id, line_no, regexp_extract(line, '^ (\\S[^|]*\\S|\\S) +\\| +(\\d+) (\\+*)(-*)$', ['path', 'changed', 'plus', 'minus']) AS r FROM {_DOC_LINES}
        WHERE regexp_matches(line, '^ (\\S[^|]*\\S|\\S) +\\| +(\\d+) (\\+*)(-*)$'))
        SELECT doc_id, line_no, r.path AS path, CAST(r.changed AS INT) AS changed, length(r.plus) AS plus, length(r.minus) AS minus FROM x""",
    "run_statuses": f"""WITH x AS (SELECT doc_id, regexp_extract(line, '^(PASS|FAIL|SKIP) (\\S+) > (.+)$', ['status', 'file', 'test']) AS r FROM {_DOC_LINES} WHERE regexp_matches(line, '^(PASS|FAIL|SKIP) (\\S+) > (.+)$'))
        SELECT doc_id, r.status AS status, count(*) AS tests, count(DISTINCT r.file) AS files FROM x GROUP BY ALL""",
    "log_levels": f"""WITH x AS (SELECT doc_id, string_split(line, ' ') AS w FROM {_DOC_LINES} WHERE regexp_matches(line, '^\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ (DEBUG|INFO|WARN|ERROR) '))
        SELECT doc_id, w[2] AS level, count(*) AS n, min(w[1]) AS first FROM x GROUP BY ALL""",
}
