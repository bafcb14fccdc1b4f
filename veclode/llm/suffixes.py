"""Suffix-array dedup: every byte covered by a string of `length` bytes that also starts elsewhere is removed.

Two equal strings of `length` bytes hold their smallest k-gram hash at the same place, so it is enough to look
at such anchors: one scan finds each text's anchors, the run of string starts that each one serves, and a hash
of all bytes those strings cover. Then

1. anchors whose k-gram occurs once in the corpus serve no repeated string and go;
2. anchors that agree in all bytes covered (copies, however many) stand for each other: all their strings repeat;
3. of each such set one anchor goes on, with the bytes its strings cover. Sampled splitters range-partition them by
   the leading tokens of the suffix that starts at the anchor. Each bucket sorts these suffixes, and what stands
   left of the anchors, read backwards, by multikey quicksort over tokens of eight raw bytes, and takes the common
   prefixes of neighbours. A string that starts d bytes left of its anchor repeats just if another anchor lies in the
   same interval of prefixes of at least length - d bytes and in the same one of d bytes to the left.
4. Anchors of a bucket's first and last k-gram may have equals beyond the boundary. How far such an anchor
   agrees with a neighbour to the right is known from the order; a second pass of the same kind orders them by
   what stands to the left. Only strings that reach no farther on either side can repeat; one of each
   kind in a bucket is compared across all boundaries by a 128-bit digest.

Strings are judged on the input; matches never cross texts. Rows are numbered once, in a written table that all steps
read.

Definitions: a null text is empty; texts shorter than `length` lose nothing; a text may repeat itself, and
overlapping strings count; repeated rows are copies of each other; an empty table gives an empty table; all
columns but the text pass through, and those named like an output are replaced.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .store import map_in_arrow, numbered, quoted, release, unused, written

GRAM = 50


def anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of every anchor: text, position, first and last start (all over the whole of data) of the strings it serves,
    its k-gram's hash and a hash of all bytes those strings cover and of where in them the anchor stands."""
    none = np.zeros(0, np.int64)
    long = np.flatnonzero(np.diff(at) >= length)
    if not len(long):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = B.prefix(data)
    n = len(data) - gram + 1
    here = np.arange(n)
    order = (B.span_hash(sums, here, here + gram) & np.uint64(0xFFFFFFFF00000000)) | here.astype(np.uint64)
    span, least = 1, order
    window = length - gram + 1
    while 2 * span <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < window:
        least = np.minimum(least[: len(data) - length + 1], least[window - span : window - span + len(data) - length + 1])
    size = np.diff(at)[long] - length + 1
    start = np.repeat(at[:-1][long] - np.cumsum(size) + size, size) + np.arange(size.sum())
    doc = np.repeat(long, size)
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    p, s, e = anchor[first], start[first], start[last]
    covered = B.mix(B.unit_hash(data, s, e + length) + (p - s).astype(np.uint64))
    return doc[first], p, s, e, B.unit_hash(data, p, p + gram, 1), covered


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """The order of rows by several keys: a quicksort by the first, then by the next one only where rows tie."""
    order = np.argsort(keys[0], kind="quicksort")
    tied = np.arange(len(order))  # places of rows that still tie
    group = keys[0][order]
    for key in keys[1:]:
        same = np.zeros(len(tied) + 1, bool)
        same[1:-1] = group[1:] == group[:-1]
        keep = same[1:] | same[:-1]
        tied, new = tied[keep], ~same[:-1][keep]
        if not len(tied):
            break
        number = np.cumsum(new)
        inner = np.lexsort((key[order[tied]], number))
        order[tied] = order[tied][inner]
        number, value = number[inner], key[order[tied]]
        new = np.ones(len(tied), bool)
        new[1:] = (number[1:] != number[:-1]) | (value[1:] != value[:-1])
        group = np.cumsum(new)
    return order


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that intervals cover."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1] if len(start) else end


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, gram_only: bool) -> Iterator[pa.RecordBatch]:
    """gram, covered, row and place: first start, anchor minus that and last start minus that, in 47, 8 and 8 bits."""
    for batch in B.pieces(batches, "text"):
        data, at = B.utf8(batch.column(0))
        doc, p, s, e, gram, covered = anchors(data, at, length)
        if gram_only:
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64))], names=["gram"])
            continue
        place = (s - at[doc]) << 16 | (p - s) << 8 | (e - s)
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(covered.view(np.int64)), pa.array(batch.column(1).to_numpy()[doc]), pa.array(place)], names=["gram", "covered", "row", "place"])


def _edge_bytes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """For each anchor listed with a text: the bytes its strings cover and the leading token at the anchor."""
    for batch in B.pieces(batches, "text", 1 << 20):
        raw = batch.column(batch.schema.get_field_index("text")).to_pylist()
        edges = batch.column(batch.schema.get_field_index("edges"))
        doc = np.repeat(np.arange(batch.num_rows), edges.value_lengths().to_numpy())
        flat = edges.flatten()
        gram, place = flat.field("gram"), flat.field("place").to_numpy()
        first, to_anchor, to_last = place >> 16, place >> 8 & 255, place & 255
        body = [raw[d][a : a + n] for d, a, n in zip(doc.tolist(), first.tolist(), (to_last + length).tolist())]
        lead = [int.from_bytes(x[a : a + 8], "big", signed=True) for x, a in zip(body, to_anchor.tolist())]
        side = [x[a + GRAM :] for x, a in zip(body, to_anchor.tolist())]
        row = batch.column(batch.schema.get_field_index("row")).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(lead, pa.int64()), gram, pa.array(side, pa.binary()), pa.array(row[doc]), pa.array(place), pa.array(body, pa.binary())], names=["lead", "gram", "side", "row", "place", "body"])


def _runs(row: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, start and end of what string starts cover, consecutive ones as one."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1 if len(row) else first
    return row[first], start[first], start[last] + length


def _reach(gram: np.ndarray, lead: np.ndarray, side: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of the bucket's first and last k-gram, and how many bytes of `side` each shares with another anchor
    of its k-gram; all of them where that may stand in another bucket."""
    order = sorted(range(len(side)), key=lambda i: (lead[i], gram[i], side[i]))
    edge = {(gram[order[0]], side[order[0]]), (gram[order[-1]], side[order[-1]])}
    at = [i for i in order if gram[i] in (gram[order[0]], gram[order[-1]])]
    reach = np.zeros(len(at), np.int64)
    for k, (i, j) in enumerate(zip(at, at[1:])):
        if gram[i] == gram[j]:
            shared = len(os.path.commonprefix([side[i], side[j]]))
            reach[k], reach[k + 1] = max(reach[k], shared), max(reach[k + 1], shared)
    for k, i in enumerate(at):
        if (gram[i], side[i]) in edge:
            reach[k] = len(side[i])
    return np.array(at, np.int64), reach


def sorted_prefixes(parts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte strings (rows, zeros behind their length) by multikey quicksort over tokens of eight bytes, and
    how many bytes each shares with the one before it in that order (0 for the first)."""
    order = multikey_order(list(parts.view(">u8").astype(np.uint64).T))
    inside = parts[order]
    differ = inside[1:] != inside[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), parts.shape[1])
    return order, np.concatenate([[0], np.minimum(shared, np.minimum(length[order][1:], length[order][:-1]))])


def _side(data: np.ndarray, start: np.ndarray, length: np.ndarray, most: int, step: int) -> np.ndarray:
    """A row for each start: the bytes from there on, forwards or backwards, with zeros behind the length."""
    k = np.arange(-(-most // 8) * 8)
    at = np.clip(start[:, None] + step * k, 0, max(len(data) - 1, 0))
    return np.where(k < length[:, None], data[at], 0).astype(np.uint8)


def _repeats(data: np.ndarray, at: np.ndarray, to_anchor: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of the strings that start from low to high bytes left of their anchors: anchor and distance of those that repeat
    another, and of one of each kind."""
    right_length, n = np.diff(at) - to_anchor, len(to_anchor)
    right, right_shared = sorted_prefixes(_side(data, at[:-1] + to_anchor, np.minimum(right_length, length), length, 1), right_length)
    left, left_shared = sorted_prefixes(_side(data, at[:-1] + to_anchor - 1, to_anchor, max(int(to_anchor.max(initial=1)), 1), -1), to_anchor)
    interval = np.empty((2, n), np.int64)
    found, kinds = [], []
    for d in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        on = np.flatnonzero((low <= d) & (d <= high))
        if not len(on):
            continue
        interval[0, right] = np.cumsum(right_shared < length - d)
        interval[1, left] = np.cumsum(left_shared < d) if d else 0
        key = interval[0, on] << 32 | interval[1, on]
        order = np.argsort(key, kind="stable")
        key, on = key[order], on[order]
        new = np.append(True, key[1:] != key[:-1])
        again = ~new
        again[:-1] |= ~new[1:]
        found.append((on[again], np.full(int(again.sum()), d)))
        kinds.append((on[new], np.full(int(new.sum()), d)))
    none = np.zeros(0, np.int64)
    joined = lambda parts: [np.concatenate([none, *(p[k] for p in parts)]) for k in (0, 1)]
    return *joined(found), *joined(kinds)


def _bucket(batches: Iterator[pa.RecordBatch], length: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Sorts one bucket's suffixes. Rows with end: covered runs. Rows with body: the anchors whose strings are compared
    beyond the bucket, with their reach to the right; in the last pass instead rows with a digest t0, t1: one for each
    kind of string that stays within its anchor's reach."""
    batches = list(batches)
    table = pa.Table.from_batches(batches) if batches else None
    if table is None or not table.num_rows:
        return
    data, at = B.utf8(table.column("body"))
    gram, row, place, lead = (table.column(c).to_numpy() for c in ("gram", "row", "place", "lead"))
    edge, reach = _reach(gram, lead, table.column("side").to_pylist())
    to_anchor = place >> 8 & 255
    low, high = to_anchor - (np.diff(at) - length), to_anchor
    if last:  # only strings within the reach of their anchor, on both sides
        left = np.full(len(row), length)
        left[edge] = reach
        low, high = np.maximum(low, length - GRAM - table.column("reach").to_numpy()), np.minimum(high, left)
    own, distance, one, one_distance = _repeats(data, at, to_anchor, low, high, length)
    r, a, b = _runs(row[own], (place[own] >> 16) + to_anchor[own] - distance, length)
    schema = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), *([(f"t{i}", pa.int64()) for i in range(2)] if last else [(c, table.schema.field(c).type) for c in ("lead", "gram", "side", "place", "body")] + [("reach", pa.int64())])])
    none = lambda k, names: [pa.nulls(k, schema.field(c).type) for c in names]
    yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(a), pa.array(b), *none(len(r), schema.names[3:])], schema=schema)
    if last:
        on = np.isin(one, edge)  # other k-grams are in this bucket only
        one, begin = one[on], (to_anchor[one] - one_distance)[on]
        start = at[:-1][one] + begin
        digest = [pa.array(B.unit_hash(data, start, start + length, k).view(np.int64)) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(row[one]), pa.array((place[one] >> 16) + begin), *none(len(one), ["end"]), *digest], schema=schema)
        return
    # For the second pass: what stands left of the anchor, from there backwards.
    body = table.column("body").take(pa.array(edge)).to_pylist()
    side = [x[:k][::-1] for x, k in zip(body, (place[edge] >> 8 & 255).tolist())]
    yield pa.RecordBatch.from_arrays([pa.array(row[edge]), *none(len(edge), ["start", "end"]), pa.array(lead[edge]), pa.array(gram[edge]), pa.array(side, pa.binary()), pa.array(place[edge]), pa.array(body, pa.binary()), pa.array(reach)], schema=schema)


def repeated_bytes(rows: DataFrame, length: int = 200, bucket_bytes: int = 2 << 20) -> DataFrame:
    """row, start and end of runs of repeated bytes (they may overlap). rows: row long and text binary, a written table."""
    if not 100 <= length <= 300:
        raise ValueError("length must be from 100 to 300 bytes")
    spark = rows.sparkSession
    rows = rows.select("text", "row")
    once = rows.select("text").mapInArrow(lambda it: _anchor_rows(it, length, True), "gram long")
    grams = written(once.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    release(spark)
    every = rows.mapInArrow(lambda it: _anchor_rows(it, length, False), "gram long, covered long, row long, place long")
    found = written(every.join(grams, "gram"))
    release(spark)
    sets = written(found.groupBy("gram", "covered").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("one")))
    # Written first, the sets are an input of their own and a hot set's anchors can be split in the join.
    whole = found.join(written(sets.where("n > 1").select("gram", "covered")), ["gram", "covered"])
    start, last = F.shiftright("place", 16), F.col("place").bitwiseAND(255)
    copies = written(whole.select("row", start.alias("start"), (start + last + length).alias("end")))
    release(spark)
    several = written(sets.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    edges = sets.join(several, "gram").select("one.row", F.struct("gram", "one.place").alias("edge"))
    edges = edges.groupBy("row").agg(F.collect_list("edge").alias("edges"))  # at most one for each anchor of the text
    listed = rows.join(edges, "row").mapInArrow(lambda it: _edge_bytes(it, length), "lead long, gram long, side binary, row long, place long, body binary")
    listed = written(listed)
    release(spark)
    by = ["lead", "gram", "side", "row", "place"]

    def dealt(df: DataFrame) -> DataFrame:
        total = df.agg(F.sum(F.octet_length("body"))).first()[0] or 0
        return df.repartitionByRange(max(1, -(-total // bucket_bytes)), *by)

    inner = written(dealt(listed).mapInArrow(lambda it: _bucket(it, length, False), "row long, start long, end long, lead long, gram long, side binary, place long, body binary, reach long"))
    edge = inner.where("end IS NULL")
    beyond = dealt(written(edge.drop("start", "end")))
    outer = written(beyond.mapInArrow(lambda it: _bucket(it, length, True), "row long, start long, end long, t0 long, t1 long"))
    boundary, tokens = outer.where("end IS NULL"), ["t0", "t1"]
    again = written(boundary.groupBy(*tokens).agg(F.count("*").alias("n")).where("n > 1").select(*tokens))
    across = boundary.join(again, tokens).select("row", "start", (F.col("start") + length).alias("end"))
    covered = [x.where("end IS NOT NULL").select("row", "start", "end") for x in (inner, outer)]
    return copies.unionByName(covered[0]).unionByName(covered[1]).unionByName(across)


def suffix_dedup(df: DataFrame, text: str = "text", length: int = 200) -> DataFrame:
    """df, without its text, with kept binary (the remaining bytes), n_bytes, n_removed and removed array<struct<start, length>>, the maximal
    removed runs in bytes of the original."""
    new = ("kept", "n_bytes", "n_removed", "removed")
    keep = [c for c in df.columns if c.lower() not in new]
    body, number = unused(df, "__text"), unused(df, "__row")
    table = numbered(df.select(*[quoted(c) for c in keep], F.encode(F.coalesce(F.col(quoted(text)), F.lit("")), "UTF-8").alias(body)).drop(*[c for c in keep if c == text]), number)
    runs = repeated_bytes(table.select(F.col(body).alias("text"), F.col(number).alias("row")), length)
    spans = runs.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rest = [c for c in keep if c != text]
    joined = table.alias("t").join(spans.alias("s"), F.col(f"t.{number}") == F.col("s.row"), "left")
    joined = joined.select(*[F.col(f"t.{quoted(c)}") for c in [*rest, body]], F.col("s.spans"))
    out = T.StructType([f for f in df.schema.fields if f.name in rest] + T._parse_datatype_string("kept binary, n_bytes long, n_removed long, removed array<struct<start:long,length:long>>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        removed_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for batch in B.pieces(batches, body, 2 << 20):
            kept, gone, found = [], [], []
            for raw, spans in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1)):
                runs = []
                if spans.is_valid:
                    flat = spans.values
                    starts, ends = (x.tolist() for x in _merged(flat.field("start").to_numpy(), flat.field("end").to_numpy()))
                    edges = [0, *(x for pair in zip(starts, ends) for x in pair), len(raw)]
                    runs = [{"start": a, "length": b - a} for a, b in zip(starts, ends)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                else:
                    kept.append(raw)
                gone.append(len(raw) - len(kept[-1]))
                found.append(runs)
            size = pa.array([a + len(b) for a, b in zip(gone, kept)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(kept, pa.binary()), size, pa.array(gone, pa.int64()), pa.array(found, removed_type)], names=out.names)

    return map_in_arrow(joined, run, out)
