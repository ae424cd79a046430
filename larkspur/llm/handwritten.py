"""Generated, minified, vendored and data files among source files.

A random forest decides about every file without a notice. Its features are compression ratio, token entropy, identifier
lengths, comment density, a few of shape, the share of literals, and the share of a file's runs of three code lines that
occur in files elsewhere. Its labels are hidden from the features: notices in the header (or at the end) of tools and
of vendored libraries, the file names that tools give, directories of third-party code, and, as no data file has a
notice, that nearly all tokens are literals. Only a file with a notice is told by the notice itself.

One narrow pass measures everything and is written to the shared checkpoint folder; the forest is fitted on at
most ``fit`` labelled rows (drawn by hash), all files are judged. Shared line runs are found by one aggregation
on the run's hash with map-side minimum and maximum of the origin, so a run met in a third of all files costs
one row a task there; files meet their runs again by a broadcast of the at most ``HOT`` hot runs, and by shuffle for the
rest. No group is gathered.

Defined results: null, empty and blank content is hand-written; null ``lines`` and ``symbols`` count as 0;
a file met again under the same workspace and path is not a copy of itself; repeated rows count once; without
any labelled file in the table no forest is fitted and only notices tell; texts are read whole. ``kind`` of a file that
is not hand-written: data by its literals, else vendored by notice or line runs, else generated.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut, spread

RUN = 3
HOT = 2000
FEATURES = ("compression", "entropy", "identifier_length", "short_identifiers", "numbered_identifiers", "comment_density", "line_length", "longest_line", "blank_share", "distinct_lines", "literal_share", "symbol_density")
MEASURED = "file_id bigint, origin bigint, notice int, marked boolean, foreign boolean, vendored boolean, data boolean, features array<double>, runs array<bigint>"

# fixed values: wordings of tools' notices
_GENERATED = re.compile(
    r"(?<!not )(?<!never )\b(?:code generated|auto-?generated|automatically generated|generated (?:by|from|with|using)|generated (?:file|code|automatically)|produced (?:from|by) \S+|wurde von \S+ (?:erzeugt|generiert)|automatisch (?:erzeugt|generiert)|fichier (?:produit|généré) par|généré automatiquement|archivo generado|generado (?:por|automáticamente))|@generated\b|<auto-generated|\bdo not (?:edit|modify)\b",
    re.IGNORECASE,
)
_VENDORED = re.compile(
    r"(?:\bvendored from \S+|\bcopied from https?://\S+|\bupstream release \S+|\bv\d+(?:\.\d+)+ \| \(c\) |\bthis file is part of the \S+ (?:library|package|project)\b|\bimported from upstream\b|\bthird[- ]party (?:code|library), do not)",
    re.IGNORECASE,
)
_BANNER = re.compile(r"/\*!\s*[\w@/.-]+ v\d+(?:\.\d+)+")
_DENIED = re.compile(r"\b(?:not|never|isn't|is no|no longer|formerly|instead of|unlike) (?:auto-?|automatically |machine-?)?generated|by hand\b(?<!modify by hand)(?<!edit by hand)", re.IGNORECASE)
_COMMENT_LINE = re.compile(r"\s*(?://|#(?!\[|!\[)|/?\*|<!--|--\s)")
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*+|[^\w\s\"']|\b\d[\w.]*+|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|[\"']")
_DIGITS = re.compile(r"\d+")
# fixed values: directories that third-party code is kept in
THIRD_PARTY = r"(?i)(?:^|/)(?:node_modules|bower_components|vendor|vendored|third[_-]?party|3rdparty|site-packages|deps|extern|external|contrib)/"
#: names that tools give to their output
MARKED = r"(?i)(?:\.(?:min|bundle|gen|generated|pb)\.|_(?:pb2?|gen|generated)\.)[a-z]+$|(?:^|/)_*(?:generated|autogen)_*/"


def notices(lines: list[str]) -> tuple[bool, bool, list[str]]:
    """(generated, vendored, lines without the notices): notices in the first or the last comment lines."""
    head = 0
    while head < len(lines) and (not lines[head].strip() or _COMMENT_LINE.match(lines[head])):
        head += 1
    tail = len(lines)
    while tail > head and (not lines[tail - 1].strip() or _COMMENT_LINE.match(lines[tail - 1])):
        tail -= 1
    generated = vendored = False
    kept = []
    for i, x in enumerate(lines):
        if head <= i < tail or not x.strip():
            if i != head or "/*!" not in x:
                kept.append(x)
                continue
        made = _GENERATED.search(x) is not None and not _DENIED.search(x)
        copied = _VENDORED.search(x) is not None
        banner = _BANNER.search(x)
        if copied:
            vendored = True
        elif made:
            generated = True
        elif banner:
            generated = True
            rest = x[x.find("*/") + 2:] if "*/" in x else ""
            if rest.strip():
                kept.append(rest)
        else:
            kept.append(x)
    return generated, vendored, kept


def measure(content: str | None, symbols: int | None, lines_known: int | None) -> tuple[int, bool, bool, list[float], list[int]]:
    """(notice, vendored, data, features, line runs) of one file."""
    text = (content or "").replace("\r\n", "\n").replace("\r", "\n")
    if not text.strip():
        return 0, False, False, [1.0] + [0.0] * (len(FEATURES) - 1), []
    generated, vendored, lines = notices(text.split("\n"))
    full = [x for x in (y.strip() for y in lines) if x]
    code = [x for x in full if not _COMMENT_LINE.match(x)]
    body, bare = "\n".join(full), "\n".join(lines)
    raw = body.encode("utf-8", "surrogatepass")
    size = max(1, len(body))
    joined = "\n".join(code)
    counts: Counter = Counter()
    names: dict[str, int] = {}
    literals = tokens = signs = held = 0
    for t, n in Counter(_TOKEN.findall(joined)).items():  # each distinct token once
        c = t[0]
        if c.isalpha() or c in "_$":
            counts[t] += n
            names[t] = n
            tokens += n
        elif c.isdigit() or c in "\"'" and len(t) > 1:
            counts["0" if c.isdigit() else '"'] += n
            held += n * len(t)
            literals += n
            tokens += n
        else:
            counts[t] += n
            signs += n
    total = max(1, tokens + signs)
    entropy = -sum(c / total * math.log2(c / total) for c in counts.values())
    known = max(1, sum(names.values()))
    features = [
        len(zlib.compress(raw, 1)) / max(1, len(raw)), entropy, sum(n * len(x) for x, n in names.items()) / known, sum(n for x, n in names.items() if len(x) <= 2) / known,
        sum(n for x, n in names.items() if x[-1].isdigit()) / known, 1.0 - sum(map(len, code)) / size, size / max(1, len(full)), float(max(map(len, full), default=0)),
        1.0 - sum(map(len, bare.split())) / max(1, len(bare)), len(set(_DIGITS.sub("0", joined).split("\n"))) / len(code) if code else 0.0,
        literals / max(1, tokens), float(symbols or 0) / max(1, len(full)),
    ]
    data = (literals >= 8 and literals >= 0.85 * tokens) or (held >= 200 and known <= 8 and held >= 0.7 * sum(len(y) for x in code for y in x.split()))
    long = [x for x in code if len(x) > 8 and not x.startswith(("import ", "from ", "use ", "package "))]
    digest = xxhash.xxh3_64_intdigest
    runs = {digest("\n".join(long[k:k + RUN]).encode("utf-8", "surrogatepass")) - (1 << 63) for k in range(len(long) - RUN + 1)}
    return int(generated), vendored, data, features, sorted(runs)


def measured(files: DataFrame) -> DataFrame:
    """One row a file: labels by notices, features without them, hashes of its line runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(*x) for x in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.int32()), batch.column(5), batch.column(6), pa.array([x[1] for x in found]), pa.array([x[2] for x in found]), pa.array([x[3] for x in found], pa.list_(pa.float64())), pa.array([x[4] for x in found], pa.list_(pa.int64()))],
                names=["file_id", "origin", "notice", "marked", "foreign", "vendored", "data", "features", "runs"],
            )

    picked = files.select(F.col("file_id").cast("long"), F.xxhash64("workspace", "file").alias("origin"), F.col("content").cast("string"), F.col("symbols").cast("int"), F.col("lines").cast("int"), F.coalesce(F.col("file").rlike(MARKED), F.lit(False)).alias("marked"), F.coalesce(F.col("file").rlike(THIRD_PARTY), F.lit(False)).alias("foreign"))
    return spread(picked).mapInArrow(run, MEASURED)


def shared_runs(rows: DataFrame) -> DataFrame:
    """(file_id, shared): the share of a file's line runs that occur in files of another place.

    Hot runs, of which there can't be more than ``HOT`` as each holds more than one ``HOT``-th of all, are broadcast: their
    many rows are never sent to one key.
    """
    pairs = rows.select("file_id", "origin", F.explode("runs").alias("run"))
    total = rows.agg(F.sum(F.size("runs"))).first()[0] or 0
    places = cut(pairs.groupBy("run").agg(F.min("origin").alias("a"), F.max("origin").alias("b"), F.count("*").alias("n")).where(f"a <> b or n * {HOT} > {total}"))
    hot = F.broadcast(places.where(f"n * {HOT} > {total}").select("run", (F.col("a") != F.col("b")).alias("hot")))
    marked = pairs.select("file_id", "run").join(hot, "run", "left")
    elsewhere = places.where(f"a <> b and n * {HOT} <= {total}").select("run")
    hits = marked.where("hot").select("file_id").unionByName(marked.where("hot is null").join(elsewhere, "run", "left_semi").select("file_id"))
    sizes = rows.select("file_id", F.size("runs").alias("of")).where("of > 0")
    return hits.groupBy("file_id").agg(F.count("*").alias("n")).join(sizes, "file_id").select("file_id", (F.col("n") / F.col("of")).alias("shared"))


def judged(files: DataFrame, fit: int = 20_000, trees: int = 32, depth: int = 8, least_shared: float = 0.5, least_forest: float = 0.4) -> DataFrame:
    """(file_id, kind, forest, noticed): kind is generated, vendored, data or null for hand-written source."""
    every = cut(measured(files))
    shared = every.drop("runs").join(shared_runs(every), "file_id", "left").withColumn("shared", F.coalesce("shared", F.lit(0.0)))
    rows = cut(shared.withColumn("features", F.concat("features", F.array("shared"))))
    noticed = (F.col("notice") == 1) | F.col("vendored")
    label = (noticed | F.col("marked") | F.col("foreign") | F.col("data")).cast("double")
    sample = rows.select(label.alias("label"), array_to_vector("features").alias("features"), "file_id").orderBy(F.xxhash64("file_id")).limit(fit)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) == 2:
        # most output of tools and many copies carry no label: both labels weigh alike, so a look that labels favour wins over its unlabelled rest
        weight = F.when(F.col("label") == 1.0, sizes[0.0] / sizes[1.0]).otherwise(1.0)
        learner = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, minInstancesPerNode=3, featureSubsetStrategy="0.5", weightCol="weight")
        forest = learner.fit(sample.withColumn("weight", weight).drop("file_id"))
        voted = forest.transform(rows.withColumn("features", array_to_vector("features")))
        rows = voted.withColumn("forest", vector_to_array("probability")[1])
    else:
        rows = rows.withColumn("forest", F.lit(0.0))
    which = F.when(F.col("data"), "data").when(F.col("vendored") | (F.col("shared") >= least_shared), "vendored").otherwise("generated")
    return rows.select("file_id", F.when(noticed | (F.col("forest") >= least_forest), which).alias("kind"), F.round("forest", 6).alias("forest"), noticed.alias("noticed"))


def causes(files: DataFrame) -> DataFrame:
    """Per kind: files told by their notice, and by the forest alone."""
    return judged(files).where("kind is not null").groupBy("kind").agg(F.count_if("noticed").alias("by_notice"), F.count_if(~F.col("noticed")).alias("by_forest"))


def found(files: DataFrame) -> DataFrame:
    """file_id of each file that nobody wrote by hand."""
    return judged(files).where("kind is not null").select("file_id").distinct()
