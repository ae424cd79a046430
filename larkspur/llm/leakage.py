"""Evaluation texts leaking into training text: pigeonhole edit matching.

Each test item's own wording (without its first line, the shared instruction) is split into e + 1 pieces of
``piece`` words, e = words // piece - 1 being its error budget: whatever is copied with at most as many changes as its
own pieces less one keeps one piece whole. Whole pieces are found in one pass over the normalised document; one hit is
enough to start verification by Myers' bit-parallel edit distance over words:

* the stretch around the hit, widened to both sides, must lie within the error budget of its own length;
* else the whole item is searched in the document near the hit, within its error budget e.

A pair is a leak when one stretch, or two in the item's order, cover ``least`` words, or when the whole item is there
with so many of its words. A stretch of fewer than ``quotation`` words does not count.

Letter case, spacing, punctuation, markup, soft hyphens, zero-width signs, ligatures and accents are
normalised away. The items are a stated query set: words get numbers, and a block of items (at most ``BLOCK_WORDS``
words, so many that the numbers of a piece fit into 62 bits) is broadcast as sorted arrays. All items below that bound,
about 100,000, cost one scan of the documents, further blocks one scan each; nothing but the found pairs is shuffled.
Work in a document is linear in its hits: hits inside a known stretch are passed over, stretches are swept once.

Defined results: null and blank texts hold nothing; an item of one line has no own wording but that line; an item
shorter than ``least`` words leaks when all of its words are held, one shorter than ``quotation`` never does; repeated
rows count once; documents are read whole at any length.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import spread

BLOCK_WORDS = 8_000_000
CHARS = 2_000_000  # characters of documents looked through at once
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤︀-️﻿̀-ͯ]")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>*#]*(?=[a-z])")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text without case, markup and typography."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "-" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text.lower())


def own_wording(text: str | None) -> str:
    """An item without its instruction line."""
    head, line_break, rest = (text or "").replace("\r\n", "\n").partition("\n")
    return rest if line_break else head


def myers(pattern: list, text: list, anywhere: bool = False) -> int:
    """Edit distance of two sequences by Myers' bit vectors, as long as the pattern; ``anywhere``: to the best part of the text."""
    m = len(pattern)
    if not m:
        return 0 if anywhere else len(text)
    peq: dict = defaultdict(int)
    for i, w in enumerate(pattern):
        peq[w] |= 1 << i
    mask, last = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best, begin = m, 0 if anywhere else 1
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & mask), pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        if score < best:
            best = score
        ph, mh = ((ph << 1) | begin) & mask, (mh << 1) & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
    return best if anywhere else score


class Items:
    """A block of items: words as numbers (0 is any other word), pieces as sorted keys with their places."""

    def __init__(self, items: list[tuple[int, list[str]]], piece: int):
        self.piece = piece
        self.number: dict[str, int] = {}
        number = self.number
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.words = [np.array([number.setdefault(x, len(number) + 1) for x in w], dtype=np.int32) for _, w in items]
        self.base = len(number) + 1
        sizes = [len(w) // piece for w in self.words]  # error budget + 1
        item = np.repeat(np.arange(len(items)), sizes)
        start = np.concatenate([np.arange(n, dtype=np.int64) * piece for n in sizes]) if items else np.zeros(0, np.int64)
        keys = np.concatenate([self._keys(w)[np.arange(n) * piece] if n else np.zeros(0, np.int64) for w, n in zip(self.words, sizes)]) if items else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.start = keys[order], item[order], start[order]

    def _keys(self, numbers: np.ndarray) -> np.ndarray:
        """The key of the ``piece`` words from each place on."""
        n = max(0, len(numbers) - self.piece + 1)
        key = np.zeros(n, np.int64)
        for k in range(self.piece):
            key = key * self.base + numbers[k:k + n]
        return key

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word of the text, item, word of the item) of each whole piece."""
        keys = self._keys(numbers)
        low = np.searchsorted(self.keys, keys)
        places = np.flatnonzero((low < len(self.keys)) & (self.keys[np.minimum(low, len(self.keys) - 1)] == keys)) if len(self.keys) else np.zeros(0, np.int64)
        low = low[places]
        n = np.searchsorted(self.keys, keys[places], side="right") - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return np.repeat(places, n), self.item[at], self.start[at]

    def held(self, item: int, doc: list, hits: list[tuple[int, int]], least: int, quotation: int) -> int:
        """Words of an item that a text holds, 0 when they are no leak."""
        w = self.words[item].tolist()
        need = min(least, len(w))
        if need < quotation:
            return 0
        n = covered(stretches(w, doc, hits, self.piece), quotation, len(w))
        if n >= need:
            return n
        budget, last = len(w) // self.piece - 1, None
        for c, a in hits:
            if last is None or abs(c - a - last) > budget:
                last = c - a
                near = doc[max(0, last - 2 * budget):last + len(w) + 2 * budget]
                if sum(map(set(near).__contains__, w)) < max(need, len(w) - budget):
                    continue  # each word of the item that is not near costs an edit
                errors = myers(w, near, anywhere=True)
                if errors <= budget and len(w) - errors >= need:
                    return len(w) - errors
        return 0


def _widen(item: list[str], doc: list[str], a: int, c: int, step: int) -> tuple[int, int]:
    """Goes on from item[a], doc[c] in one direction while words agree, over single edits followed by two agreements."""
    def same(x: int, y: int) -> bool:
        return 0 <= x < len(item) and 0 <= y < len(doc) and item[x] == doc[y]

    while True:
        if same(a, c):
            a, c = a + step, c + step
            continue
        for da, dc in ((1, 1), (0, 1), (1, 0), (2, 2), (1, 2), (2, 1)):
            x, y = a + da * step, c + dc * step
            if same(x, y) and same(x + step, y + step):
                a, c = x, y
                break
        else:
            return a, c


def stretches(item: list, doc: list, hits: list[tuple[int, int]], piece: int) -> list[tuple[int, int, int, int]]:
    """(item from, to, document from, to) of the verified stretches around hits, which come in the order of the document."""
    out: list[tuple[int, int, int, int]] = []
    open_: list[tuple[int, int, int, int]] = []  # stretches that the next hits may lie in
    for c, a in hits:
        open_ = [x for x in open_ if x[3] > c]
        if any(x[0] <= a < x[1] and x[2] <= c and abs((c - a) - (x[2] - x[0])) <= x[4] for x in open_):
            continue
        b, d = _widen(item, doc, a + piece, c + piece, 1)
        a, c = _widen(item, doc, a - 1, c - 1, -1)
        a, c = a + 1, c + 1
        errors = myers(item[a:b], doc[c:d])
        if errors <= max(1, (b - a) // piece - 1):
            out.append((a, b, c, d))
            open_.append((a, b, c, d, errors))
    return sorted(set(out), key=lambda x: (x[2], x))


def covered(found: list[tuple[int, int, int, int]], quotation: int, words_: int) -> int:
    """Words of the item covered by the best one or two stretches in its order: one sweep over the document."""
    good = [x for x in found if x[1] - x[0] >= quotation]
    best = max((b - a for a, b, _, _ in good), default=0)
    longest = [0] * (words_ + 1)  # of the stretches passed, the longest that ends at this word of the item or before
    ends = [0] * (words_ + 1)  # ... that ends exactly there
    passed = sorted(good, key=lambda x: x[3])
    k = 0
    for a, b, c, _ in good:
        while k < len(passed) and passed[k][3] - 2 <= c:
            e, size = passed[k][1], passed[k][1] - passed[k][0]
            ends[e] = max(ends[e], size)
            for j in range(e, words_ + 1):
                if longest[j] >= size:
                    break
                longest[j] = size
            k += 1
        for end, size in ((a, longest[a]), *((e, ends[e]) for e in range(a + 1, min(a + 3, words_ + 1)))):
            if size:
                best = max(best, size + max(0, b - end))
    return best


def _blocks(items: DataFrame, piece: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Items normalised where they lie and fetched row by row, in blocks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words(own_wording(x)) for x in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["i", "w"])

    rows = items.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null").distinct()
    block: list = []
    held, kinds = 0, set()
    for row in rows.mapInArrow(run, "i bigint, w array<string>").toLocalIterator():
        if block and (held + len(row.w) > BLOCK_WORDS or (len(kinds) + len(row.w) + 1) ** piece >= 1 << 62):
            yield block
            block, held, kinds = [], 0, set()
        block.append((row.i, row.w))
        held += len(row.w)
        kinds.update(row.w)
    yield block


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(ids, texts), about ``CHARS`` characters at once; a longer document comes alone and whole."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        start = held = 0
        for i in range(len(texts) + 1):
            size = len(texts[i] or "") if i < len(texts) else CHARS + 1
            if i > start and held + size > CHARS:
                yield ids[start:i], texts[start:i]
                start, held = i, 0
            held += size


def leaks(documents: DataFrame, items: DataFrame, least: int = 20, quotation: int = 8, piece: int = 3) -> DataFrame:
    """(doc_id, item_id, covered): each pair of a document and an item that leaked into it."""
    spark = documents.sparkSession
    texts = spread(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    schema = "doc_id bigint, item_id bigint, covered int"
    made: dict[int, Items] = {}

    def scan(held, key):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if key not in made:
                made[key] = Items(held.value, piece)
            block = made[key]
            number = block.number.get
            for ids, texts in _slices(batches):
                docs = [words(t) for t in texts]
                starts = np.cumsum([0, *(len(d) + 1 for d in docs)])
                numbers = np.zeros(int(starts[-1]), np.int32)  # a 0 after each document
                for s, d in zip(starts.tolist(), docs):
                    numbers[s:s + len(d)] = [number(x, 0) for x in d]
                at, item, start = block.hits(numbers)
                doc = np.searchsorted(starts, at, side="right") - 1
                order = np.lexsort((start, at, item, doc))
                at, item, start, doc = at[order], item[order], start[order], doc[order]
                cuts = np.flatnonzero(np.diff(doc) | np.diff(item)) + 1
                rows = []
                for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                    if s < e:
                        d, k = int(doc[s]), int(item[s])
                        first = int(starts[d])
                        got = block.held(k, numbers[first:int(starts[d + 1]) - 1].tolist(), list(zip((at[s:e] - first).tolist(), start[s:e].tolist())), least, quotation)
                        if got:
                            rows.append((ids[d], int(block.ids[k]), got))
                cols = list(zip(*rows)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], names=["doc_id", "item_id", "covered"])

        return run

    out = None
    for k, block in enumerate(_blocks(items, piece)):
        part = texts.mapInArrow(scan(spark.sparkContext.broadcast(block), k), schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"))


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items).select("doc_id", "item_id")


def report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item with a leak: suite, item_id, the documents that hold it and the most words held."""
    hit = leaks(documents, items).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("covered").alias("most_words"))
    return items.select("item_id", "suite").distinct().join(hit, "item_id")
