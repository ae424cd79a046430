"""The core's queries over the given tables, and the SQL that says the same.

Each applies one operator to whole tables. Where the SQL of an operator would be another program (parsers,
extraction, edits), there is none and the operator is tested on fixtures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, text
from .operators import diagnostics, extract, fuzzy, graph, index, joins, plantree, search, shred, timeline
from .plans.tables import spread, table

HOUR, MINUTE, DAY = 3_600_000_000, 60_000_000, 86_400_000_000


def _days(column: str) -> F.Column:
    return F.unix_date(F.col(column).cast("date"))


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").withColumn("us", timeline.micros(F.col("ts")))


# search --------------------------------------------------------------------------------------------


def _asked(rows: DataFrame, which: str) -> DataFrame:
    return rows.where(which).select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))


def knn_topk(s, d):
    """The ten nearest vectors to every vector whose id is divisible by 50."""
    rows = table(s, d, "embeddings")
    return search.knn(rows, _asked(rows, "vec_id % 50 = 0"), "vec_id", "embedding", 10).select("q_id", "vec_id", "score")


def knn_scoped(s, d):
    """The ten nearest of label 3 to every vector whose id is divisible by 50."""
    rows = table(s, d, "embeddings")
    return search.knn(rows, _asked(rows, "vec_id % 50 = 0"), "vec_id", "embedding", 10, F.col("label") == 3).select("q_id", "vec_id", "score")


def grep_content(s, d):
    return search.grep(table(s, d, "documents"), "text", "the", ["doc_id"], ignore_case=True)


def grep_files(s, d):
    return search.grep_files(search.grep(table(s, d, "documents"), "text", "lease", ["doc_id"]), ["doc_id"])


def grep_count(s, d):
    return search.grep_count(search.grep(table(s, d, "documents"), "text", "the", ["doc_id"], ignore_case=True), ["doc_id"])


def grep_code_glob(s, d):
    return search.grep(table(s, d, "source_files"), "content", "return ", ["file_id"], glob=F.col("file").endswith(".py")).select("file_id", "line_no")


def text_search(s, d):
    """Lines of code with ``log.`` and the outline symbol that holds each."""
    hits = search.grep(table(s, d, "source_files"), "content", r"log\.", ["file_id"])
    symbols = table(s, d, "outline_symbols").select("file_id", "name", "start_line", "end_line").distinct()
    return search.text_search(hits, symbols, ["file_id"]).select("file_id", "line_no", "name")


# joins ---------------------------------------------------------------------------------------------


def _visits(s, d):
    lines = table(s, d, "lineitem").join(table(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    points = lines.select(F.col("o_custkey").alias("cust"), "l_orderkey", "l_linenumber", _days("l_shipdate").alias("day"))
    spans = table(s, d, "orders").select(F.col("o_custkey").alias("cust"), "o_orderkey", _days("o_orderdate").alias("s"))
    return points, spans


def interval_first(s, d):
    points, spans = _visits(s, d)
    pairs = joins.interval_join(points, spans.withColumn("e", F.col("s") + 30), ["cust"], "day", "s", "e", 30)
    return joins.first_interval(pairs, ["l_orderkey", "l_linenumber", "day"], "s", ["o_orderkey"]).select("l_orderkey", "l_linenumber", "o_orderkey")


def interval_innermost(s, d):
    points, spans = _visits(s, d)
    both = spans.withColumn("e", F.col("s") + 30).unionByName(spans.withColumn("e", F.col("s") + 90))
    pairs = joins.interval_join(points, both, ["cust"], "day", "s", "e", 60)
    got = joins.first_interval(pairs, ["l_orderkey", "l_linenumber", "day"], "s", ["o_orderkey"], "e")
    return got.select("l_orderkey", "l_linenumber", "o_orderkey", (F.col("e") - F.col("s")).alias("span"))


def asof_backward(s, d):
    """Each purchase with the latest view of its user at or before it."""
    e = _events(s, d)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "us")
    right = e.where("event_type = 'view'").select("user_id", "us", F.col("event_id").alias("view_id"), "event_id")
    return joins.asof_backward(left, right, "user_id", "us", "event_id", ["view_id"], DAY).select("event_id", "view_id")


def longest_prefix(s, d):
    """Each source file's deepest directory that is the directory of a file with at least 5 symbols."""
    files = table(s, d, "source_files").select("file_id", "file", "symbols")
    roots = files.where("symbols >= 5").select(paths.directory(F.col("file")).alias("root")).where("root <> ''").distinct()
    return joins.longest_prefix(files.select("file_id", "file"), F.col("file"), roots, "root", ["file_id"]).select("file_id", "root")


def all_prefixes(s, d):
    files = table(s, d, "source_files").select("file_id", "file", "symbols")
    roots = files.where("symbols >= 5").select(paths.directory(F.col("file")).alias("root")).where("root <> ''").distinct()
    return joins.longest_prefix(files.select("file_id", "file"), F.col("file"), roots, "root", ["file_id"], every=True).groupBy("file_id").agg(F.count("*").alias("roots"))


def first_candidate(s, d):
    """Each part with the first of its type, brand and container name that a large part has."""
    p = table(s, d, "part")
    known = p.where("p_size > 45").select(F.col("p_type").alias("target")).union(p.where("p_size > 40").select("p_brand")).distinct()
    rows = p.select("p_partkey", "p_type", "p_brand")
    return joins.first_candidate(rows, F.array("p_type", "p_brand"), known, "target", ["p_partkey"]).select("p_partkey", "target", "candidate")


def ref_left_join(s, d):
    """Words of documents against the words of part names, the unresolved kept."""
    refs = table(s, d, "documents").select("doc_id", F.explode(F.split("text", "[^A-Za-z0-9_]+")).alias("word")).where("word <> ''").distinct()
    known = table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return joins.unresolved_left(refs, known, ["word"], "word").select("doc_id", "word")


def outline_tree(s, d):
    return joins.children_of(table(s, d, "region").select("r_regionkey", "r_name"), table(s, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), "r_regionkey", "n_name", ["n_name"], "nations")


def enclosing_symbol(s, d):
    """Each outline symbol with the smallest other one of its file that encloses it."""
    o = table(s, d, "outline_symbols").select("file_id", "symbol_id", "start_line", "end_line").dropna().dropDuplicates(["symbol_id"])
    return joins.enclosing(o, "file_id", "start_line", "end_line", ["symbol_id"]).select("symbol_id", F.col("parent.symbol_id").alias("parent_id"))


def anti_embed(s, d):
    """Ids of outline symbols that have no vector yet."""
    o = table(s, d, "outline_symbols")
    ids = o.select(F.concat(F.lit("/ws/"), "workspace", F.lit("/"), "file", F.lit("::"), "name", F.lit("::"), F.col("start_line").cast("string")).alias("id")).where("id is not null").distinct()
    return index.missing_ids(ids, table(s, d, "symbol_vectors"))


def live_vectors(s, d):
    o = table(s, d, "outline_symbols")
    ids = o.select(F.concat(F.lit("/ws/"), "workspace", F.lit("/"), "file", F.lit("::"), "name", F.lit("::"), F.col("start_line").cast("string")).alias("id")).where("id is not null").distinct()
    return table(s, d, "symbol_vectors").select("label", "id").distinct().join(ids, "id", "left_semi").select("label", "id")


# graph and index -----------------------------------------------------------------------------------


def _graph(s, d):
    pairs = table(s, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    return graph.edges(pairs)


def _parts(s, d):
    return table(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("file"), "p_type", "p_size")


def typeref_edges(s, d):
    """Files linked by the type names they refer to, each to every file of its workspace that defines the name."""
    files = table(s, d, "source_files").where("content is not null").withColumn("workspace", F.coalesce("workspace", F.lit("")))
    path, keep = F.concat("workspace", F.lit("/"), "file").alias("file"), ("workspace",)
    key = lambda column: F.concat("workspace", F.lit("::"), column).alias("name")
    return graph.reference_edges(extract.type_references(files, keep).select(path, key("ref")), extract.symbols(files, keep).select(path, key("name")))


def in_degree(s, d):
    return graph.in_degree(_parts(s, d).select("file"), _graph(s, d))


def file_rank(s, d):
    degrees = graph.in_degree(_parts(s, d), _graph(s, d))
    return graph.ranks(degrees, F.col("p_size") > 40, F.col("p_size") < 10).select("file", F.round("rank", 6).alias("rank"))


def edge_count(s, d):
    return _graph(s, d).agg(F.count("*").alias("edges"))


def graph_nodes(s, d):
    return graph.nodes(_graph(s, d))


def snapshot_diff(s, d):
    """Documents against a snapshot in which some are gone, some changed and some new."""
    old = table(s, d, "documents").select("doc_id", "n_chars")
    new = old.where("doc_id % 7 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))).unionByName(old.where("doc_id % 11 = 0").withColumn("doc_id", F.col("doc_id") + 10_000_000))
    return index.snapshot_diff(old, new, "doc_id", "n_chars")


def upsert_latest(s, d):
    return index.latest_by(_events(s, d), ["user_id", "event_type"], ["event_id", "value"], ["us", "event_id"]).select("user_id", "event_type", "event_id", "value")


def newest_files(s, d):
    """The newest row of each file met again."""
    f = table(s, d, "source_files").select("workspace", "file", "file_id", F.unix_micros("indexed_at").alias("us"))
    return index.latest_by(f, ["workspace", "file"], ["file_id"], ["us", "file_id"])


def index_summary(s, d):
    files = table(s, d, "source_files").select(F.col("file_id").alias("file"), "lines", "rank", "imports", "exports")
    o = table(s, d, "outline_symbols").select("symbol_id", F.col("file_id").alias("file"), "end_line").dropDuplicates(["symbol_id"])
    im = files.select("file", F.explode("imports").alias("source"))
    ex = files.select("file", F.explode("exports").alias("name"))
    got = index.summary(files.select("file", "lines"), o, files.select("file", "rank"), im, ex)
    return got.select("file", "lines", "symbols", F.round("rank", 6).alias("rank"), F.array_join("imports", ",").alias("imports"), F.array_join("exports", ",").alias("exports"))


def lang_stats(s, d):
    o = table(s, d, "outline_symbols").withColumn("language", paths.language(F.col("file")))
    return index.language_stats(o)


def dir_summary(s, d):
    return index.directory_summary(table(s, d, "source_files"))


def symbol_lookup(s, d):
    return index.lookup_partial(table(s, d, "outline_symbols").select("symbol_id", "name").distinct(), "shard")


def resolver(s, d):
    o = table(s, d, "outline_symbols").select("symbol_id", "name", "file", "start_line", "end_line").distinct()
    return index.resolve(o, "Shard").select("symbol_id", "tier")


def serialize_text(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", index.serialise(F.lit("part"), F.col("p_name"), F.concat("p_brand", F.lit(": "), "p_type"), F.lit(""), F.col("p_brand")).alias("text"), index.symbol_id(F.col("p_brand"), F.col("p_name"), F.col("p_size")).alias("id"))


def token_budget_prefix(s, d):
    docs = table(s, d, "documents").select("doc_id", F.coalesce(source_of("source"), F.lit("")).alias("source"), "n_chars").where("n_chars is not null")
    return index.within_budget(docs, ["source"], "doc_id", text.token_estimate(F.col("n_chars")), 20_000).select("doc_id", "running")


def source_of(column: str) -> F.Column:
    return F.lower(F.trim(column))


def top_files(s, d):
    f = table(s, d, "source_files").select("file_id", F.coalesce("rank", F.lit(0.0)).alias("rank"), F.col("file_id").alias("file"))
    return index.tiered_top(f, f.count()).select("file_id", F.round("rank", 6).alias("rank"))


def siblings(s, d):
    o = table(s, d, "outline_symbols").select("symbol_id", "file_id", "name", "start_line").dropDuplicates(["symbol_id"])
    return timeline.siblings(o, "file_id", ["start_line", "symbol_id"], "name").select("symbol_id", "previous", "following")


def did_you_mean(s, d):
    """The three shortest symbol names that hold or are held by a name asked for."""
    return search.did_you_mean(table(s, d, "outline_symbols").select("name").distinct(), "name", "shard", 3)


# diagnostics ---------------------------------------------------------------------------------------


def _diagnostics(s, d):
    level = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    return table(s, d, "events").select("event_id", level.alias("severity"), F.concat(F.lit("u"), "user_id").alias("file"), F.col("event_id").alias("line"), F.when(F.col("user_id") % 5 > 0, F.concat(F.lit("r"), F.col("user_id") % 5)).alias("root"))


def diag_query(s, d):
    return diagnostics.query(_diagnostics(s, d), "warning").select("event_id", "severity", "file")


def diag_summary(s, d):
    return diagnostics.summary(_diagnostics(s, d))


def diag_by_group(s, d):
    return diagnostics.summary_by(_diagnostics(s, d))


def diag_filtered_after_limit(s, d):
    return diagnostics.summary(diagnostics.query(_diagnostics(s, d), "info", root="r1"))


def run_errors(s, d):
    """Reported errors of the index runs by workspace."""
    runs = table(s, d, "index_runs").dropDuplicates(["run_id"])
    return runs.select("workspace", F.explode_outer("errors").alias("e")).groupBy("workspace").agg(F.count("e").alias("errors"), F.countDistinct("e.file").alias("files"))


# time ----------------------------------------------------------------------------------------------


def dedup_thinning(s, d):
    return timeline.thin(_events(s, d).select("event_id", "event_type", "us"), "event_type", "us", "event_id", HOUR).select("event_id", "event_type")


def debounce_session(s, d):
    return timeline.debounce(_events(s, d).select("event_id", "event_type", "us"), "event_type", "us", "event_id", 30 * MINUTE).select("event_id", "event_type")


# trees ---------------------------------------------------------------------------------------------


def _tasks(s, d):
    flat = shred.plan_entities(shred.shred(table(s, d, "plan_records"))).where("entity = 'task'")
    return flat.select(F.col("rec_id").alias("plan_id"), "path", "parent", "status", (F.col("checkpoint") == "true").alias("checkpoint"))


def p1_progress(s, d):
    return plantree.progress(_tasks(s, d))


def p1_promoted(s, d):
    return plantree.promote(_tasks(s, d)).select("plan_id", "path", "status")


def p1_current(s, d):
    return plantree.current_task(_tasks(s, d))


def p1_pending_checkpoints(s, d):
    saved = shred.plan_entities(shred.shred(table(s, d, "plan_records"))).where("entity = 'checkpoint'").select(F.col("rec_id").alias("plan_id"), F.col("taskid").alias("path"))
    return plantree.pending_checkpoints(_tasks(s, d), saved).select("plan_id", "path")


def p1_context(s, d):
    flat = shred.plan_entities(shred.shred(table(s, d, "plan_records"))).withColumnRenamed("rec_id", "plan_id")
    entries = flat.where("entity in ('finding', 'decision', 'file')").select("plan_id", "entity", "path", "parent", "text")
    return plantree.context_rollup(entries, _tasks(s, d))


def p1_entities(s, d):
    return shred.plan_entities(shred.shred(table(s, d, "plan_records")))


def tree_rollup(s, d):
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    done = c.select(F.col("n_regionkey").alias("plan_id"), F.when(F.col("c_acctbal") > 0, "completed").otherwise("pending").alias("status"))
    return plantree.progress(done)


# text and edits ------------------------------------------------------------------------------------


def snippet3(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", text.first_lines(F.col("text")).alias("snippet"))


def _blocks(s, d):
    lines = search.numbered_lines(table(s, d, "documents").where("text is not null"), "text", ["doc_id"])
    return fuzzy.sliding_blocks(lines, ["doc_id"], 2)


def sliding_block_match(s, d):
    """Two-line blocks of documents, of any length, that stand in more than one place."""
    return _blocks(s, d).groupBy("block").agg(F.count("*").alias("places"), F.countDistinct("doc_id").alias("documents")).where("places > 1")


def fuzzy_levenshtein(s, d):
    return fuzzy.near_names(table(s, d, "part"), "p_brand", "p_name", "p_partkey", 3)


def json_props(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def text_scalars(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", text.slug(F.concat("p_name", F.lit(" "), "p_type")).alias("slug"), paths.short_name(F.concat("p_brand", F.lit("."), "p_name")).alias("short"), text.token_estimate(F.length("p_name")).alias("tokens"), text.one_space(F.concat(F.lit("  "), "p_name", F.lit("   x "))).alias("spaced"), text.bytes_text((F.col("p_size") * 100).cast("long")).alias("size"))


def set_operations(s, d):
    """Union, difference and intersection of supplier and customer nations."""
    a, b = table(s, d, "supplier").select(F.col("s_nationkey").alias("k")), table(s, d, "customer").select(F.col("c_nationkey").alias("k"))
    tag = lambda df, name: df.select(F.lit(name).alias("op"), "k")
    return tag(a.union(b).distinct(), "union").union(tag(b.subtract(a), "except")).union(tag(a.intersect(b), "intersect"))


def file_page(s, d):
    """Lines 3 to 12 of every file."""
    from .sources.files import read_page

    return read_page(search.numbered_lines(table(s, d, "source_files"), "content", ["file_id"]), 3, 10).select("file_id", "line_no", "line")


def glob_files(s, d):
    from .sources.files import glob_regex

    return table(s, d, "source_files").where(F.col("file").rlike(glob_regex("src/**/*.{ts,py}"))).select("file_id", "file")


def grep_context(s, d):
    """Lines with ``except`` or ``catch`` and two lines around each."""
    rows = table(s, d, "source_files")
    every = search.numbered_lines(rows.where(F.col("content").rlike("except|catch")), "content", ["file_id"])
    hits = search.grep(rows, "content", "except|catch", ["file_id"])
    return search.with_context(every, hits, ["file_id"], 2).select("file_id", "line_no", "line")


def nearest_hit(s, d):
    """For each outline symbol the line nearest to its start, at most ten away, that holds its name."""
    o = table(s, d, "outline_symbols").select("symbol_id", "file_id", "name", "start_line").dropna().dropDuplicates(["symbol_id"])
    lines = search.numbered_lines(table(s, d, "source_files").where("content is not null"), "content", ["file_id"])
    near = o.withColumn("line_no", F.explode(F.sequence(F.col("start_line") - 10, F.col("start_line") + 10)))
    met = near.join(lines, ["file_id", "line_no"]).where(F.contains("line", F.col("name")))
    return timeline.nearest(met, ["symbol_id"], F.col("line_no") - F.col("start_line"), ["line_no"]).select("symbol_id", "line_no")


def last_events(s, d):
    """Each user's last 20 events."""
    from pyspark.sql import Window

    e = _events(s, d)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("us").desc(), F.col("event_id").desc()))
    return e.withColumn("n", n).where("n <= 20").select("user_id", "event_id")


def ignore_filter(s, d):
    """Files that ordered ignore rules leave: the last match decides, ! takes back."""
    from .sources.files import ignore_predicate

    rules = ["dist/", "*.min.js", "/lib", "!lib/**/*.ts", "node_modules"]
    return table(s, d, "source_files").where(~ignore_predicate(F.col("file"), rules)).select("file_id")


def language_map(s, d):
    return table(s, d, "source_files").select("file_id", paths.language(F.col("file")).alias("language"), paths.base_name(F.col("file")).alias("base"), paths.directory(F.col("file")).alias("directory"), paths.extension(F.col("file")).alias("ext"))


def class_outlines(s, d):
    """Members listed in the outline's children, with their class."""
    o = table(s, d, "outline_symbols").dropDuplicates(["symbol_id"])
    return o.where("kind = 'class'").select("symbol_id", "name", F.explode("children").alias("c")).select("symbol_id", F.concat_ws(".", "name", "c.name").alias("member"), F.col("c.start_line").alias("start_line"))


def member_dependencies(s, d):
    """Members that each class's snippet refers to through this or self, unresolved ones as properties."""
    o = table(s, d, "outline_symbols").where("kind = 'class'").dropDuplicates(["symbol_id"]).select(F.col("symbol_id").alias("class"), F.col("snippet").alias("code"), "children")
    members = o.select("class", F.explode("children").alias("c")).select("class", F.col("c.name").alias("name"), F.col("c.kind").alias("kind"))
    return index.dependencies(o.select("class", "code"), members)


def shorten_texts(s, d):
    t = table(s, d, "documents").where("text is not null")
    return t.select("doc_id", text.shorten(F.col("text"), 10).alias("head"), text.shorten(F.col("text"), 10, tail=True).alias("tail"))


def log_summary(s, d):
    """Event properties as log fields: long ones by size, with the day they belong to."""
    from .sources.logs import call_log

    e = table(s, d, "events").select("event_id", "ts", F.col("props").alias("input"), F.repeat("props", 30).alias("output"))
    return call_log(e).select("event_id", "date", "input", "output")


def paged(s, d):
    return search.page(table(s, d, "part").select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")], 15, 30)


def maintained(s, d):
    """The index after a snapshot: rows of removed and changed files replaced."""
    old = table(s, d, "source_files").select("file_id", "lines").dropDuplicates(["file_id"])
    new = old.where("file_id % 9 <> 0").withColumn("lines", F.when(F.col("file_id") % 4 == 0, F.coalesce("lines", F.lit(0)) + 1).otherwise(F.col("lines")))
    return index.maintain(old, index.snapshot_diff(old, new, "file_id", "lines"), new, "file_id")


def directory_tree(s, d):
    """Directories and files down to two levels, with the count of entries in each."""
    from .sources.files import tree

    listed = table(s, d, "source_files").select(F.col("file").alias("path")).distinct()
    return tree(listed, 2).select("path", "parent", "is_dir", "children")


def edited_files(s, d):
    """Each file's second line replaced through the edit cascade, found by its trimmed text."""
    f = table(s, d, "source_files").select("file_id", F.regexp_replace("content", "\r", "").alias("content"))
    line = F.try_element_at(F.split("content", "\n"), F.lit(2))
    edits = F.array(F.struct(F.trim(line).alias("old_text"), F.lit("EDITED").alias("new_text"), F.lit(2).alias("line_hint")))
    return fuzzy.apply_edits(f.withColumn("edits", edits)).select("file_id", F.try_element_at("strategies", F.lit(1)).alias("strategy"), F.md5("result").alias("result"))


def text_embedding(s, d):
    """Deterministic trigram embeddings of part names."""
    from .functions.vectors import trigram_embedding

    e = trigram_embedding(F.col("p_name"), 16)
    return spread(table(s, d, "part").select("p_partkey", "p_name")).select("p_partkey", F.array_join(F.transform(e, lambda x: F.round(x, 4).cast("string")), ",").alias("embedding"))


def p1_cancelled(s, d):
    t = _tasks(s, d)
    return plantree.cancel(t, t.where("path = '1'").select("plan_id", "path")).select("plan_id", "path", "status")


def symbols_extract(s, d):
    """Symbols of every file with signatures and docs, under the file's own id."""
    return extract.symbols(table(s, d, "source_files"), ("workspace", "file_id"))


def imports_extract(s, d):
    return extract.imports(table(s, d, "source_files"), ("workspace", "file_id"))


def type_refs_extract(s, d):
    return extract.type_references(table(s, d, "source_files"), ("workspace", "file_id"))


def drift_lookup(s, d):
    """Where each outline symbol's name stands in its file now, whatever line was recorded."""
    o = table(s, d, "outline_symbols").select("symbol_id", "file_id", F.regexp_extract("name", r"^([A-Za-z_$][\w$]*)$", 1).alias("name"), "start_line").where("name <> '' and start_line is not null").dropDuplicates(["symbol_id"])
    lines = search.numbered_lines(table(s, d, "source_files").where("content is not null"), "content", ["file_id"])
    return search.drift_lookup(o, lines, ["file_id"], "symbol_id").select("symbol_id", "line_no", "tier")


def _document_lines(s, d):
    return search.numbered_lines(table(s, d, "documents").where("text is not null"), "text", ["doc_id"])


def diffstat_lines(s, d):
    """Lines of diff summaries that stand in documents."""
    from .sources.git import diffstat

    return diffstat(_document_lines(s, d)).select("doc_id", "line_no", "path", "changed", "plus", "minus")


def run_statuses(s, d):
    """Results of tests that stand in documents, counted per document and status."""
    from .sources.testruns import status_lines

    return status_lines(_document_lines(s, d)).groupBy("doc_id", "status").agg(F.count("*").alias("tests"), F.countDistinct("file").alias("files"))


def log_levels(s, d):
    """Log lines that stand in documents, counted per document and level, with the first time."""
    from .sources.logs import leveled

    return leveled(_document_lines(s, d)).groupBy("doc_id", "level").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def queries() -> dict:
    named = [
        knn_topk, knn_scoped, grep_content, grep_files, grep_count, grep_code_glob, text_search, interval_first, interval_innermost, asof_backward, longest_prefix, all_prefixes, first_candidate,
        ref_left_join, outline_tree, enclosing_symbol, anti_embed, live_vectors, typeref_edges, in_degree, file_rank, edge_count, graph_nodes, snapshot_diff, upsert_latest, newest_files, index_summary,
        lang_stats, dir_summary, symbol_lookup, resolver, serialize_text, token_budget_prefix, top_files, siblings, did_you_mean, diag_query, diag_summary, diag_by_group, diag_filtered_after_limit,
        run_errors, dedup_thinning, debounce_session, tree_rollup, snippet3, sliding_block_match, fuzzy_levenshtein, json_props, text_scalars, set_operations, file_page, glob_files,
        grep_context, nearest_hit, last_events, ignore_filter, language_map, class_outlines, member_dependencies, shorten_texts, log_summary, paged, maintained, directory_tree,
        edited_files, text_embedding, p1_cancelled, symbols_extract, imports_extract, type_refs_extract, drift_lookup, diffstat_lines, run_statuses, log_levels, p1_entities, p1_progress, p1_promoted, p1_current, p1_pending_checkpoints, p1_context,
    ]
    return {"p1_found": lambda s, d: shred.plan_nodes(table(s, d, "plan_records"))} | {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return SQL
