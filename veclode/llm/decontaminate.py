"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The test items' word bigrams are seeds. Each occurrence of a seed in a training text, however common the
seed is, opens a window in which the item could stand around it; windows that overlap make a region. A
region is dropped if it holds one seed only (of an item of SHORT words or more: an alignment that reaches half of an
exact copy's score has at least two, but for copies with words inserted everywhere), or if no alignment in it can
reach min_score, as too few of its words are words of the item. With the others the item is aligned by Smith-Waterman over words (match 2, mismatch -1, gap -1), and
alignments whose score is at least min_score of an exact copy's are reported. What is found in a text
depends on no other text, so one pass is enough and no text is shuffled. Items are broadcast in blocks of
at most `most_seeds` n-grams, one step of that pass for each block.

Definitions: words are runs of ASCII letters, digits and bytes from 128, in lower case; punctuation and
white space don't count. Null and empty texts match nothing, and so do items of fewer than LEAST or n words;
identical items each report; an item id that is null is kept as null; repeated rows are all reported; an
empty table on either side gives no matches. Other columns pass through and `matches` replaces a column
of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .store import map_in_arrow
from .toxicity import lower

_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_MULTIPLY = np.uint64(0xC2B2AE3D27D4EB4F)
#: Items of fewer words are aligned wherever one seed stands, longer ones where two do.
SHORT = 9
#: Items of fewer words match nothing.
LEAST = 3


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row and the n + 1 offsets."""
    _, start, end, first = B.words(data, at, _APART)
    return B.unit_hash(lower(data), start, end), first


def ngrams(word: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first words of all n-grams that lie in one text, and their hashes."""
    if len(word) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rolled = np.zeros(len(word) - n + 1, np.uint64)
    for j in range(n):
        rolled = rolled * _MULTIPLY + word[j : j + len(rolled)]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    here = np.flatnonzero(doc[: len(rolled)] == doc[n - 1 :])
    return here, B.mix(rolled[here])


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The best Smith-Waterman score of two word sequences and the end of its alignment in text."""
    columns = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        new = np.zeros(len(text) + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(text == word, 2, -1), row[1:] - 1)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + columns) - columns  # gaps along the text
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


class Items:
    """A block of test items: words, seeds (sorted hashes) and where each seed stands."""

    def __init__(self, ids: list, data: np.ndarray, at: np.ndarray, n: int):
        self.ids, self.n = ids, n
        self.word, self.first = word_hashes(data, at)
        here, hashes = ngrams(self.word, self.first, n)
        enough = np.diff(self.first)[np.searchsorted(self.first, here, "right") - 1] >= LEAST
        here, hashes = here[enough], hashes[enough]
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at = hashes[order], here[order]
        self.seeds, self.begin = np.unique(self.hashes, return_index=True)
        self.begin = np.append(self.begin, len(self.hashes))
        self.own = np.unique(self.pairs(self.word, np.repeat(np.arange(len(ids)), np.diff(self.first))))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the hashes that are seeds, and of their seeds."""
        if not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        seed = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
        hit = np.flatnonzero(self.seeds[seed] == hashes)
        return hit, seed[hit]

    @staticmethod
    def pairs(word: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Hashes of words together with an item's number."""
        return B.mix(word * _MULTIPLY + item.astype(np.uint64))

    def most(self, word: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A bound on the score of any alignment of item[i] with word[start[i]:end[i]] (none is empty): a word of
        the item adds two at most, another word takes one away."""
        size = end - start
        at = np.cumsum(size) - size
        window = np.repeat(np.arange(len(size)), size)
        here = np.arange(len(window)) - np.repeat(at - start, size)
        pair = self.pairs(word[here], item[window])
        worth = np.where(self.own[np.minimum(np.searchsorted(self.own, pair), len(self.own) - 1)] == pair, 2, -1)
        sums = np.cumsum(worth) - window * (4 * len(window))  # so far apart that each window starts anew
        before = np.minimum.accumulate(sums - worth)
        return np.maximum.reduceat(sums - before, at)


def _shares(sizes: np.ndarray, most: int = 1 << 18) -> list[tuple[int, int]]:
    """Cuts of a sequence into shares whose sizes add up to about most."""
    share = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(sizes)]
    return list(zip(cuts[:-1], cuts[1:])) if len(sizes) else []


def _windows(items: Items, first: np.ndarray, here: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Text, item, start, end and number of seeds of the windows of seeds that stand at here."""
    # Every occurrence of each seed in the items.
    times = items.begin[seed + 1] - items.begin[seed]
    where = items.at[np.repeat(items.begin[seed], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    position = np.repeat(here, times)
    item = np.searchsorted(items.first, where, "right") - 1
    doc = np.searchsorted(first, position, "right") - 1
    length = (items.first[1:] - items.first[:-1])[item]
    slack = length // 2 + 4
    start = np.maximum(position - (where - items.first[item]) - slack, first[doc])
    end = np.minimum(position - (where - items.first[item]) + length + slack, first[doc + 1])
    order = np.lexsort((end, start, item, doc))
    rows = np.stack([doc, item, start, end])[:, order]
    new = np.flatnonzero(np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)))
    return np.concatenate([rows[:, new], np.diff(np.append(new, len(order)))[None]])


def _match(items: Items, word: np.ndarray, first: np.ndarray, min_score: float) -> dict[int, list[dict]]:
    """By text: the alignments that reach min_score."""
    here, hashes = ngrams(word, first, items.n)
    hit, seed = items.find(hashes)
    found: dict[int, list[dict]] = {}
    if not len(hit):
        return found
    windows = np.concatenate([_windows(items, first, here[hit[a:b]], seed[a:b]) for a, b in _shares(items.begin[seed + 1] - items.begin[seed])], axis=1)
    doc, item, start, end, hits = windows[:, np.lexsort((windows[3], windows[2], windows[1], windows[0]))]
    # Both ends of an item's windows grow together, so a window that overlaps another overlaps the one before it.
    new = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(item) != 0) | (start[1:] > end[:-1])))
    hits = np.add.reduceat(hits, new)
    doc, item, start, end = doc[new], item[new], start[new], end[np.append(new[1:], len(end)) - 1]
    on = np.flatnonzero(hits >= np.where(items.first[item + 1] - items.first[item] < SHORT, 1, 2))
    doc, item, start, end = doc[on], item[on], start[on], end[on]
    if not len(doc):
        return found
    bound = np.concatenate([items.most(word, item[a:b], start[a:b], end[a:b]) for a, b in _shares(end - start)])
    keep = bound >= min_score * 2 * (items.first[item + 1] - items.first[item])
    regions = zip(doc[keep].tolist(), item[keep].tolist(), start[keep].tolist(), end[keep].tolist())
    for d, i, a, b in regions:
        own, text = items.word[items.first[i] : items.first[i + 1]], word[a:b]
        best, stop = align(own, text)
        if best >= min_score * 2 * len(own):
            back, back_end = align(own[::-1], text[:stop][::-1])
            begin = a + stop - back_end - first[d]
            found.setdefault(d, []).append({"item_id": items.ids[i], "score": best / (2 * len(own)), "start": int(begin), "length": int(back_end)})
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 2, min_score: float = 0.5, most_seeds: int = 1_000_000) -> DataFrame:
    """docs with matches: array<struct<item_id, score (share of an exact copy's), start, length (in words)>>."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(item_text), F.lit(""))
    tests = benchmark.select(F.col(item_id).alias("item_id"), body.alias("text"))
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (2 * most_seeds)))  # a seed has at least a letter and a separator
    kind = T.ArrayType(T.StructType([T.StructField("item_id", benchmark.schema[item_id].dataType), *T._parse_datatype_string("score double, start int, length int").fields]))
    out = docs.drop("matches").withColumn("matches", F.array().cast(kind))
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    for k in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        items = Items(part.column("item_id").to_pylist(), *B.utf8(part.column("text")), n)
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in B.pieces(batches, text):
                word, first = word_hashes(*B.utf8(batch.column(batch.schema.get_field_index(text))))
                found = _match(sent.value, word, first, min_score)
                at = batch.schema.get_field_index("matches")
                old = batch.column(at)
                if found:
                    old = pa.array([x + found.get(i, []) for i, x in enumerate(old.to_pylist())], arrow)
                yield pa.RecordBatch.from_arrays([old if j == at else c for j, c in enumerate(batch.columns)], names=batch.schema.names)

        out = map_in_arrow(out, run, out.schema)
    return out
