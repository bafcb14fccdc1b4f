"""Substring dedup by hashed lines or paragraphs, and line dedup by prefix doubling over line-ID sequences.

Both rank occurrences by (id, unit number): the earliest stays, later ones go. Units are counted and
joined by digest (partial aggregates, then joins that adaptive execution can split), so a line that
half of all documents share meets in no single task.

Definitions: a null text is an empty text and stays as it is; a null id ranks first; rows that share
an id rank equal, so identical rows keep or lose the same units; an empty table gives an empty table;
other columns pass through and columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .store import map_in_arrow, quoted, written

SEPARATORS = {"line": "\n", "paragraph": "\n\n"}


def _text(text: str) -> F.Column:
    return F.coalesce(F.col(quoted(text)), F.lit(""))


def _without(df: DataFrame, removed: DataFrame, id: str, text: str, separator: str) -> DataFrame:
    """df with n_units, n_removed, removed_spans (start and length of each removed unit in the original, in
    code points) and text without them. removed: __id, __key, units array<int>."""
    kept = [c for c in df.columns if c.lower() not in ("n_units", "n_removed", "removed_spans")]
    keyed = df.select(F.struct(*map(quoted, kept)).alias("row"), F.col(quoted(id)).alias("id"), F.xxhash64(_text(text)).alias("key"))
    joined = keyed.join(removed, keyed["id"].eqNullSafe(removed["__id"]) & (keyed["key"] == removed["__key"]), "left").select("row.*", "units")
    out = T.StructType([df.schema[c] for c in kept] + T._parse_datatype_string("n_units int, n_removed int, removed_spans array<struct<start:int,length:int>>").fields)
    spans = out["removed_spans"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        at_text = kept.index(text)
        for batch in B.pieces(batches, at_text, 2 << 20):
            texts, counts, gone, found = [], [], [], []
            for x, units in zip(batch.column(at_text).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                parts = (x or "").split(separator)
                drop = set(units or ())
                at, cut = 0, []
                if drop:
                    for i, p in enumerate(parts):
                        if i in drop:
                            cut.append({"start": at, "length": len(p)})
                        at += len(p) + len(separator)
                    x = separator.join(p for i, p in enumerate(parts) if i not in drop)
                texts.append(x)
                counts.append(len(parts))
                gone.append(len(drop))
                found.append(cut)
            columns = dict(zip(kept, batch.columns))
            columns[text] = pa.array(texts, pa.string())
            columns |= {"n_units": pa.array(counts, pa.int32()), "n_removed": pa.array(gone, pa.int32()), "removed_spans": pa.array(found, to_arrow_type(spans))}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in out.fields], names=[f.name for f in out.fields])

    return map_in_arrow(joined, run, out)


def substring_dedup(df: DataFrame, id: str = "doc_id", text: str = "text", unit: str = "line", min_words: int = 5) -> DataFrame:
    """Removes every line (or paragraph) of at least min_words words whose normalised form - lower case, white
    space runs as one space, trimmed - stood at an earlier (id, unit) position. Returns df with the new text,
    n_units, n_removed and removed_spans."""
    separator = SEPARATORS[unit]
    units = df.select(F.col(quoted(id)).alias("__id"), F.xxhash64(_text(text)).alias("__key"), F.posexplode(F.split(_text(text), separator)).alias("__unit", "__line"))
    normal = F.trim(F.regexp_replace(F.lower("__line"), r"[ \t\n\u000B\f\r]+", " "))
    units = units.select("__id", "__key", "__unit", normal.alias("__line")).where(F.length("__line") - F.length(F.replace("__line", F.lit(" "), F.lit(""))) + 1 >= min_words)
    units = units.select("__id", "__key", "__unit", F.unhex(F.md5("__line")).alias("__digest"))
    first = units.groupBy("__digest").agg(F.min(F.struct("__id", "__unit")).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    # Written first, they are an input of their own and a hot line's rows can be split in the join.
    later = units.join(written(first), "__digest").where(~F.struct("__id", "__unit").eqNullSafe(F.col("__first")))
    removed = later.groupBy("__id", "__key").agg(F.collect_set("__unit").alias("units"))
    return _without(df, removed, id, text, separator)


def _lines(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """One row for each line: its 128-bit digest, and the lengths of the shortest runs of at least min_words
    words that start (forward) and end (backward) with it, 0 if there is none."""
    for batch in B.pieces(batches, "__text"):
        data, at = B.utf8(batch.column(batch.schema.get_field_index("__text")))
        n = len(at) - 1
        breaks = np.flatnonzero(data == 10)
        owner = np.searchsorted(at, breaks, "right") - 1
        start = np.sort(np.concatenate([at[:-1], breaks + 1]))
        order = np.argsort(np.concatenate([np.arange(n), owner]), kind="stable")
        start = np.concatenate([at[:-1], breaks + 1])[order]
        doc = np.concatenate([np.arange(n), owner])[order]
        first = np.searchsorted(doc, np.arange(n + 1))
        end = np.empty_like(start)
        end[:-1] = start[1:] - 1
        end[first[1:] - 1] = at[1:]
        number = np.arange(len(start)) - first[doc]
        low, w, _, _ = B.words(data, at)
        total = np.searchsorted(w, end) - np.searchsorted(w, start)
        sums = np.concatenate([[0], np.cumsum(total)])
        here = np.arange(len(start))
        stop = np.searchsorted(sums, sums[:-1] + min_words)  # the end of the shortest run from here
        forward = np.where((stop <= first[doc + 1]) & (stop < len(sums)), stop - here, 0)
        begin = np.searchsorted(sums, sums[1:] - min_words, "right") - 1  # the start of the shortest run to here
        backward = np.where((sums[1:] >= min_words) & (begin >= first[doc]), here + 1 - begin, 0)
        a, b = B.unit_hash(data, start, end), B.unit_hash(data, start, end, 1)
        take = pa.array(doc, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("__id")).take(take), batch.column(batch.schema.get_field_index("__key")).take(take), pa.array(number, pa.int32()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(forward, pa.int32()), pa.array(backward, pa.int32())],
            names=["__id", "__key", "line", "a", "b", "forward", "backward"],
        )


def repeated_lines(df: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = 20) -> DataFrame:
    """__id, __key, units: the lines inside runs of whole lines, of at least min_words words together, that
    also occur at an earlier (id, line) position.

    Prefix doubling: at level k each live suffix of a line sequence carries the class of its first 2**k lines,
    named by the earliest position that has them; level k + 1 names the pairs of classes that stand 2**k lines
    apart. The first m lines of a suffix are then named by two overlapping classes of the level below m, which
    is the suffix's LCP interval of depth m. A line lies in a repeated run of enough words just if it lies in
    one of the shortest such runs from or to some line, so only those depths are looked up.
    """
    key = df.select(F.col(quoted(id)).alias("__id"), F.xxhash64(_text(text)).alias("__key"), _text(text).alias("__text"))
    id_type = df.schema[id].dataType.simpleString()
    lines = key.mapInArrow(lambda it: _lines(it, min_words), f"__id {id_type}, __key long, line int, a long, b long, forward int, backward int")
    lines = lines.withColumn("__id", F.struct(F.col("__id").alias("id")))  # never null, so that null ids meet in joins
    earlier = ~F.struct(F.col("__id").alias("id"), F.col("line").alias("line")).eqNullSafe(F.struct("class.id", "class.line"))
    first = lines.groupBy("a", "b").agg(F.min(_name()).alias("class"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Written first, the counts are an input of their own and a hot line's rows can be split in the join.
    level = written(lines.join(written(first), ["a", "b"]).drop("a", "b"))
    # Shortest runs: (start, length) in a document; of one line they are decided at level 0.
    runs = level.select("__id", "__key", F.explode(F.array(F.struct(F.col("line").alias("line"), F.col("forward").alias("m")), F.struct((F.col("line") - F.col("backward") + 1).alias("line"), F.col("backward").alias("m")))).alias("run"))
    runs = written(runs.where("run.m > 1").select("__id", "__key", "run.*").distinct())
    same_text = ["__id", "__key"]
    single = level.where((F.col("forward") == 1) & earlier).select(*same_text, F.col("line"), F.lit(1).alias("m"))
    found = [single]
    longest = runs.agg(F.max("m")).first()[0] or 1
    classes = level.select(*same_text, "line", "class")
    if longest > 1:
        classes = written(classes.dropDuplicates([*same_text, "line"]))  # repeated rows stand for one another
    k = 0
    while 2 ** (k + 1) <= longest:
        # Level k + 1: the classes of pairs that stand 2**k lines apart.
        pairs = _apart(classes, classes.select(*same_text, "line", F.col("class").alias("next")), 2**k)
        classes = written(_named(pairs))
        k += 1
        here = runs.where((F.col("m") >= 2**k) & (F.col("m") < 2 ** (k + 1)))
        exact = here.where(F.col("m") == 2**k).join(classes, [*same_text, "line"])
        exact = exact.where(earlier).select(*same_text, "line", "m")
        inner = here.where(F.col("m") > 2**k).join(classes, [*same_text, "line"])
        tail = classes.select(*same_text, F.col("line").alias("tail"), F.col("class").alias("next"))
        inner = inner.withColumn("tail", F.col("line") + F.col("m") - 2**k).join(tail, [*same_text, "tail"]).drop("tail")
        # Written level by level: one plan of all levels' joins would run them, and send their small sides, at once.
        found.append(written(exact.unionByName(_named(inner, "m").where(earlier).select(*same_text, "line", "m"))))
    covered = found[0]
    for more in found[1:]:
        covered = covered.unionByName(more)
    covered = covered.select(*same_text, F.explode(F.sequence(F.col("line"), F.col("line") + F.col("m") - 1)).alias("line"))
    return covered.groupBy(*same_text).agg(F.collect_set("line").alias("units")).withColumn("__id", F.col("__id.id"))


def _apart(a: DataFrame, b: DataFrame, distance: int) -> DataFrame:
    return a.join(b.withColumn("line", F.col("line") - distance), ["__id", "__key", "line"])


def _name() -> F.Column:
    """A position, as occurrences are ranked, and the text's digest, as texts can share an id."""
    return F.struct(F.col("__id").alias("id"), F.col("line").alias("line"), F.col("__key").alias("key"))


def _named(pairs: DataFrame, *more: str) -> DataFrame:
    """pairs with class: the earliest position whose class and next (and more) are equal."""
    by = ["class", "next", *more]
    # Written first, the names are an input of their own and a common pair's rows can be split in the join.
    first = written(pairs.groupBy(*by).agg(F.min(_name()).alias("first")))
    return pairs.join(first, by).drop(*[c for c in by if c not in more]).withColumnRenamed("first", "class")


def line_dedup(df: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = 20) -> DataFrame:
    """Deletes later copies of repeated runs of whole lines (see repeated_lines; line breaks are line feeds).
    Returns df with the new text, n_units (lines), n_removed and removed_spans."""
    return _without(df, repeated_lines(df, id, text, min_words), id, text, "\n")
