"""Keyword-stuffed pages and link lists, by perplexity under a prose-trained model of word classes.

A text becomes sequences of function words and word classes (links and tags are classes of their own; signs, numbers
and technical tokens stand outside of the sequences). A trigram model with interpolated back-off is counted over the
prose of all documents. A page is cut into units: sentences, and runs of lines that are no sentences. Two perplexities
of the model decide about a unit:

* high: the mean surprisal of its classes lies more than ``HIGH`` standard errors above the model's own entropy, as
  prose doesn't string content words, links or tags together without function words between;
* low: with the page as a cache (each content word predicted by the rest of its page, by the word before it), the mean
  surprisal of its content words lies more than ``LOW`` standard errors below that of prose: the same few keywords
  predict one another.

Entropy and deviations are fitted on the prose of all documents. An exact check takes units of another kind out:
logs, listings, dependencies and tables (paths, identifiers, timestamps, versions and numbers), code (its signs), and
units of which more than every fifth word is a function word. A page is flagged when the abnormal units left hold more
than ``half`` of its characters, i.e. when its median character stands in one.

Model size: the classes are fixed (about 500), so the counted trigrams, which are collected and broadcast, are
bounded by the classes and don't grow with the pages. Scoring is narrow: no shuffle beyond the counts. A worker reads
each distinct chunk of characters once (a memo of bounded size) and scores whole slices of documents as arrays.

Defined results: null and blank texts are not flagged; ties at exactly half are not flagged; a repeated doc_id
counts once; without any prose in the table nothing is abnormal; ``source`` and ``lang`` are not read; texts are read
whole at any length; scripts without blanks between words give no sequences and are not flagged.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import spread

# fixed values: function words of languages met on developer pages
FUNCTION_WORDS = frozenset(
    """the a an of to in on for and or if is are was were be been by with that this these it its we you they he she i as at from but not no so than then
    which who when while where because unless until since after before into over under about out up your our their my his her any each every all both has have had
    can could will would should may must do does did how what why there here though although whenever whether without yet once only also just
    der die das den dem des ein eine einen einem eines und oder ist sind war wird im in am an auf aus bei bis für mit nach nicht noch nur ob ohne sich sie so sobald solange
    über um und unter vom von vor wenn wie wir zu zum zur er es ich ihr man als auch dass aber keinen keine kein jede jeder bevor weil
    le la les l un une des du de et ou est sont en dans sur sous par pour avec sans ce cet cette ces qui que quoi dont où il elle ils elles on nous vous je tu ne pas plus
    au aux si dès avant après pendant depuis chaque toutes tous leur son sa ses mais comme quand
    el los las lo uno unos unas y o u es son era está en con sin por para que quien cuando donde se su sus al del no más como si tras antes después solo cada todas todos pero porque hasta
    il gli nel della dei che non per con una sono di da e ed più anche come quando se
    o os as um uma do dos na nos que não por com se mais como para de em
    het een van niet met voor zijn naar als ook maar wordt werd op te bij
    och att det som är på för med den inte av till om var har ett eller när og er ikke til af fra kan vi jeg på ja tai on ei että se mutta kun jos myös
    w z na do i nie się jest to że od po przy przez dla jak ale gdy jego oraz a v na je že se s při od po jako ale když aby
    ve bir bu için ile da de ne ama gibi daha olan olarak her çok sonra kadar az a és nem hogy egy is meg csak ha de vagy mint și în cu pe la nu este sau din
    yang dan di ke dari untuk dengan tidak ini itu pada adalah atau jika akan
    и в не на с что по для как из от к а но или если при это его за о до после то же бы так когда все уже есть затем всё весь всего всех каждый каждой каждого та не на що з як до для але або це від""".split()
)
HIGH, LOW = 4.5, 5.5
_TOKEN = re.compile(
    r"(?P<U>(?:https?://|ftp://|www\.)[^\s<>\"')\]]+)|(?P<H>\#[^\W\d_][\w-]*|\#\d+[^\W\d_][\w-]*)"
    r"|(?P<T>\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d)?\S*)?|\b\d\d:\d\d:\d\d\S*)|(?P<V>[\^~v=]*\d+(?:\.\d+)+(?:-\w+)?)"
    r"|(?P<I>`[^`\n]*`|(?<![\w.-])[\w.-]*+/[\w./-]+|\w+(?:::\w+)+|[^\W\d]\w*\(\w*\)|[^\W\d_]+_\w+|[a-z]+[A-Z]\w*|[A-Z][a-z]+(?:[A-Z][a-z]+)+\w*|\w+\.(?:ts|js|py|go|rs|json|md|ya?ml|toml|txt|java|c|h)\b|\b[0-9a-f]{7,40}\b)"
    r"|(?P<N>\d[\d,]*%?)|(?P<W>[^\W\d_]+(?:['’][^\W\d_]+)*(?:-[^\W\d_]+)*\d*)|(?P<P>[^\w\s])|(?P<X>\w+)"
)
_ANCHOR = re.compile(r"<a\b[^<>]*?href\s*=\s*[\"']?([^\"'\s<>]+)[^<>]*>", re.IGNORECASE)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_SPAN = re.compile(r"`[^`\n]*`")
_ENDINGS = ("ing", "ly", "ed", "er", "est", "s", "en", "e", "ung", "ción", "tion", "a", "o")
_CODE_SIGNS = "[]={}"
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]")

# the alphabet of the model: its two marks, kinds of tokens, content words by ending, function words
CLASSES = ["<s>", "</s>", *"UHTVINXPC", "<w>", *(f"<w{k}>" for k in range(len(_ENDINGS))), *sorted(FUNCTION_WORDS)]
CLASS = {name: i for i, name in enumerate(CLASSES)}
SIZE = len(CLASSES)
START, END = CLASS["<s>"], CLASS["</s>"]
CONTENT, FUNCTION = CLASS["<w>"], CLASS["<w>"] + 1 + len(_ENDINGS)  # content classes end where function words begin
CHARS = 1_000_000  # characters of documents laid out at once
MEMO = 300_000  # chunks a worker remembers
VOCABULARY = 8192.0  # words a word not met on its page is drawn from


def word_class(word: str) -> int:
    """The class of a word in lower case: function words stand for themselves, others by their ending."""
    got = CLASS.get(word) if word in FUNCTION_WORDS else None
    if got is not None:
        return got
    for k, end in enumerate(_ENDINGS):
        if word.endswith(end) and len(word) > len(end) + 2:
            return CONTENT + 1 + k
    return CONTENT


class Lexer(dict):
    """Chunk of characters without blanks -> its number; the tokens of a chunk are read once."""

    def __init__(self):
        self.start, self.classes, self.words = array("q", [0]), array("q"), array("q")
        self.chars, self.begins, self.ends = array("q"), array("b"), array("b")

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self.chars)
        for m in _TOKEN.finditer(chunk):
            kind, word = m.lastgroup, 0
            if kind == "W" and (m.group().isascii() or not _UNSPACED.search(m.group())):
                low = m.group().lower()
                c = word_class(low)
                word = xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) >> 1
            elif kind == "P":
                c = CLASS["C" if m.group() in _CODE_SIGNS else "P"]
            else:
                c = CLASS[kind if kind != "W" else "X"]
            self.classes.append(c)
            self.words.append(word)
        self.start.append(len(self.classes))
        self.chars.append(len(chunk) + 1)
        first, last = chunk[0], chunk.rstrip("\"')»”’`")[-1:]
        self.begins.append(first.isupper() or first in "«\"'`([" or not (first.isascii() or first.isalpha()))
        self.ends.append(bool(last) and last in ".!?…。")
        return number


def _numbers(values: array, kind=np.int64) -> np.ndarray:
    return np.array(values, dtype=kind)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = False
        for x in columns:
            out[1:] |= x[1:] != x[:-1]
    return out


def _occurrences(keys: np.ndarray) -> np.ndarray:
    """How often the key of each row occurs."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse]


class Pages:
    """Documents laid out as arrays: tokens in pieces (sentences or lines), pieces in units, units in documents."""

    def __init__(self, lexer: Lexer, texts: list[str | None]):
        chunks, per_line, per_doc = array("q"), array("q"), array("q")
        for text in texts:
            lines = 0
            if text:
                if "<" in text:
                    text = _TAG.sub(" ", _ANCHOR.sub(r" \1 ", text))
                if "`" in text:
                    text = _SPAN.sub(" `x` ", text)
                for line in text.splitlines():
                    parts = line.split()
                    if parts:
                        chunks.extend(map(lexer.__getitem__, parts))
                        per_line.append(len(parts))
                        lines += 1
            per_doc.append(lines)
        ids, per_line, per_doc = _numbers(chunks), _numbers(per_line), _numbers(per_doc)
        self.docs = len(texts)
        line = np.repeat(np.arange(len(per_line)), per_line)
        begins, ends = _numbers(lexer.begins, np.int8)[ids] > 0, _numbers(lexer.ends, np.int8)[ids] > 0
        first = _changes(line)
        first[1:] |= ends[:-1] & begins[1:]
        piece = np.cumsum(first) - 1
        pieces = int(first.sum())
        last = np.ones(len(ids), bool)
        last[:-1] = first[1:]
        closed = ends[last]
        doc = np.repeat(np.arange(len(per_doc)), per_doc)[line[first]]
        heads = _changes(doc)
        heads[1:] |= closed[1:] | closed[:-1]
        self.unit_of_piece = np.cumsum(heads) - 1
        self.units = int(heads.sum())
        self.unit_doc = doc[heads]
        chars = np.bincount(piece, _numbers(lexer.chars)[ids], pieces)
        self.unit_chars = np.bincount(self.unit_of_piece, chars, self.units)
        start = _numbers(lexer.start)
        size = start[ids + 1] - start[ids]
        at = np.repeat(start[ids] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        every, of = _numbers(lexer.classes)[at], np.repeat(piece, size)
        self.by_kind = np.zeros((7, self.units))  # technical, numeric, code signs, links, tags, content and function words
        tech = np.isin(every, [CLASS["I"], CLASS["T"]])
        kinds = (tech, np.isin(every, [CLASS[x] for x in "VNX"]), every == CLASS["C"], every == CLASS["U"], every == CLASS["H"], (every >= CONTENT) & (every < FUNCTION), every >= FUNCTION)
        for k, mask in enumerate(kinds):
            self.by_kind[k] = np.bincount(self.unit_of_piece[of[mask]], minlength=self.units)
        in_piece = [np.bincount(of[m], minlength=pieces) for m in (tech, kinds[3] | kinds[4], kinds[5] | kinds[6], kinds[6])]
        #: prose may train the model: words with function words between, no links or tags
        self.prose = (in_piece[2] >= 5) & (in_piece[3] >= 0.15 * in_piece[2]) & (in_piece[1] == 0) & (in_piece[0] <= 2)
        kept = kinds[3] | kinds[4] | kinds[5] | kinds[6]
        self.c, self.piece, self.word = every[kept], of[kept], _numbers(lexer.words)[at][kept]
        self.doc = doc[self.piece]
        self.unit = self.unit_of_piece[self.piece]
        self.first = _changes(self.piece)

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, pieces) of all class trigrams, each piece closed by its end mark."""
        if not len(self.c):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        b = np.roll(self.c, 1)
        b[self.first] = START
        a = np.roll(b, 1)
        a[self.first] = START
        last = np.roll(self.first, -1)
        keys = np.concatenate([(a * SIZE + b) * SIZE + self.c, (b[last] * SIZE + self.c[last]) * SIZE + END])
        return keys, np.concatenate([self.piece, self.piece[last]])

    def cached(self) -> np.ndarray:
        """Surprisal of each token as a word, predicted by the rest of its page and the word before it."""
        if not len(self.c):
            return np.zeros(0)
        content = (self.c >= CONTENT) & (self.c < FUNCTION)
        with np.errstate(over="ignore"):
            word = np.where(content, self.word, self.c * np.int64(0x1234567890123)) * np.int64(0x1E3779B97F4A7C15)
            one = word ^ ((self.doc + 1) * np.int64(0x2545F4914F6CDD1D))
            two = one * np.int64(31) + np.roll(word, 1) * np.int64(0x5851F42D4C957F2D)
        single, pair = _occurrences(one), _occurrences(np.where(self.first, one, two))
        total = np.bincount(self.doc, minlength=self.docs)[self.doc]
        p = (single - 1 + 8 / VOCABULARY) / (total - 1 + 8)
        before = np.maximum(np.roll(single, 1) - 1, 0)
        return -np.log2(np.where(self.first, p, (pair - 1 + 2 * p) / (before + 2)))


class Model:
    """Interpolated trigram model of word classes with its entropy and deviations, as arrays.

    counts: trigram key -> occurrences in prose; moments: number, sum and sum of squares of the surprisals of the
    content words of prose with their page as a cache.
    """

    def __init__(self, counts: dict[int, float], moments: tuple[float, float, float] = (0.0, 0.0, 0.0)):
        self.keys = np.array(sorted(counts), dtype=np.int64)
        self.n = np.array([counts[k] for k in self.keys.tolist()], dtype=np.float64)
        c, ab = self.keys % SIZE, self.keys // SIZE
        single = np.bincount(c, self.n, SIZE)
        pair = np.bincount(ab % SIZE * SIZE + c, self.n, SIZE * SIZE).reshape(SIZE, SIZE)
        self.context = np.bincount(ab, self.n, SIZE * SIZE)
        self.total = float(single.sum())
        p = (single + 0.5) / (self.total + 0.5 * SIZE)
        self.pair = ((pair + 8 * p) / (pair.sum(axis=1, keepdims=True) + 8)).ravel()
        s = self.surprisal(self.keys)
        self.entropy, self.deviation = self._moments(self.total, float(s @ self.n), float((s * s) @ self.n))
        self.cache_entropy, self.cache_deviation = self._moments(*moments)

    @staticmethod
    def _moments(n: float, total: float, squares: float) -> tuple[float, float]:
        mean = total / n if n else 0.0
        return mean, math.sqrt(max(0.0, squares / n - mean * mean)) if n else 0.0

    def surprisal(self, keys: np.ndarray) -> np.ndarray:
        """Bits of the last class of each trigram, at most 16."""
        n = np.zeros(len(keys))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            n = np.where(self.keys[at] == keys, self.n[at], 0.0)
        ab = keys // SIZE
        return np.minimum(16.0, -np.log2((n + 8 * self.pair[ab % SIZE * SIZE + keys % SIZE]) / (self.context[ab] + 8)))

    def high(self, pages: Pages) -> np.ndarray:
        """Standard errors by which the mean surprisal of each unit's classes exceeds the entropy."""
        keys, piece = pages.trigrams()
        unit = pages.unit_of_piece[piece]
        n = np.maximum(1, np.bincount(unit, minlength=pages.units))
        mean = np.bincount(unit, self.surprisal(keys), pages.units) / n
        return (mean - self.entropy) * np.sqrt(n) / self.deviation if self.deviation else np.zeros(pages.units)

    def low(self, pages: Pages) -> np.ndarray:
        """Standard errors by which the mean surprisal of each unit's content words, its page a cache, falls below prose."""
        content = (pages.c >= CONTENT) & (pages.c < FUNCTION)
        n = np.bincount(pages.unit[content], minlength=pages.units)
        mean = np.bincount(pages.unit[content], pages.cached()[content], pages.units) / np.maximum(1, n)
        return np.where(n >= 4, (self.cache_entropy - mean) * np.sqrt(n) / self.cache_deviation, 0.0) if self.cache_deviation else np.zeros(pages.units)


def other_kind(pages: Pages) -> np.ndarray:
    """The exact check: units that are logs, listings, tables, code, or have the function words of sentences."""
    technical, numeric, signs, links, tags, content, function = pages.by_kind
    size = np.maximum(1.0, pages.by_kind.sum(axis=0) - signs)
    return (technical > 0.1 * size) | (technical + numeric > 0.34 * size) | ((signs > 0.15 * size) & (links == 0)) | (function > 0.2 * (content + function))


def spam_shares(pages: Pages, model: Model) -> np.ndarray:
    """The share of each document's characters in units of abnormal perplexity that are of no other kind."""
    abnormal = ((model.high(pages) > HIGH) | (model.low(pages) > LOW)) & ~other_kind(pages)
    total = np.bincount(pages.unit_doc, pages.unit_chars, pages.docs)
    return np.bincount(pages.unit_doc, pages.unit_chars * abnormal, pages.docs) / np.maximum(1.0, total)


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Pages]]:
    """Rows with their documents laid out, about ``CHARS`` characters at once; a longer document comes alone and whole."""
    lexer = Lexer()
    for batch in batches:
        texts = batch.column(column).to_pylist()
        start = held = 0
        for i in range(len(texts) + 1):
            size = len(texts[i] or "") if i < len(texts) else CHARS + 1
            if i > start and held + size > CHARS:
                if len(lexer) > MEMO:
                    lexer = Lexer()
                yield batch.slice(start, i - start), Pages(lexer, texts[start:i])
                start, held = i, 0
            held += size


MOMENTS = (-1, -2, -3)


def _counts(documents: DataFrame) -> DataFrame:
    """(key, n): class trigrams of the prose of all documents and, under ``MOMENTS``, the cached surprisals' moments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pages in _slices(batches, 0):
            keys, piece = pages.trigrams()
            keys, n = np.unique(keys[pages.prose[piece]], return_counts=True)
            s = pages.cached()[pages.prose[pages.piece] & (pages.c >= CONTENT) & (pages.c < FUNCTION)]
            yield pa.RecordBatch.from_arrays([pa.array([*keys.tolist(), *MOMENTS], pa.int64()), pa.array([*n.tolist(), len(s), float(s.sum()), float((s * s).sum())], pa.float64())], names=["key", "n"])

    return documents.select(F.col("text").cast("string")).mapInArrow(run, "key bigint, n double").groupBy("key").agg(F.sum("n").alias("n"))


def train(documents: DataFrame) -> Model:
    counts = {r.key: r.n for r in _counts(documents).toLocalIterator()}
    moments = tuple(counts.pop(k, 0.0) for k in MOMENTS)
    return Model(counts, moments)


def scores(documents: DataFrame) -> DataFrame:
    """(doc_id, share): the share of each document's text that is spam."""
    picked = spread(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    held = documents.sparkSession.sparkContext.broadcast(train(picked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, pages in _slices(batches, 1):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(spam_shares(pages, held.value), pa.float64())], names=["doc_id", "share"])

    return picked.mapInArrow(run, "doc_id bigint, share double")


def found(documents: DataFrame, half: float = 0.5) -> DataFrame:
    """doc_id of each page of which more than half is keywords, links or tags."""
    return scores(documents).where(F.col("share") > half).select("doc_id").distinct()
