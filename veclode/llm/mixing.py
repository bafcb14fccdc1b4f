"""Language-model scoring by logistic context mixing of hashed-context bit predictors.

A text is a sequence of tokens (words, then one end); a token is coded as its bytes and a closing space,
each byte as the bits of a Huffman code fitted to the training words. Every bit is predicted from six
hashed contexts: the last one, two and three bytes, the word so far, and the word so far and the last two
bytes together with a class of the previous word. The predictors' counts are gathered from all training
tokens; their logits are mixed by weights that a gate chooses by how often the contexts were seen; and the
mix is refined by an adaptive probability map. Weights and map are learned online over the training tokens, all those
of one (word, class) at once, each bit predicted as if one token of it had been left
out; each task learns from its share of the pairs and the tasks' weights are averaged. A text's score is the sum of
its bits' log probabilities and nothing else, so over all token sequences the probabilities sum to one at most.
Training texts are scored with one occurrence of each of their own tokens left out.

Because a token's probability depends on the token and the previous word's class alone, each distinct
(word, class) is scored once. The most frequent pairs, at most `frequent`, are broadcast; all other tokens
meet their scores in a join, so vocabulary and counts grow with the corpus while no task holds them all.
The predictors' tables grow with the number of pairs, up to 2**MOST_MORE times; each learner's share is summed along
a tree. bits_per_byte is over the bytes coded: the tokens', each with its closing space, in lower case.

Definitions: words are runs of bytes other than space and bytes 9 to 13, A-Z in lower case; a null text is
an empty one, which has its end as only token; repeated rows are scored alike and each counts when
learning; a null id learns; without training rows counts are zero; an empty table gives an empty table.
Columns besides id and text are not read. df is read twice: to count and to score.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .store import numbered, quoted, release, written

CLASSES, END = 8, 32
#: Table sizes of the six contexts, as powers of two.
BITS = (16, 18, 20, 20, 20, 18)
OFFSET = np.concatenate([[0], np.cumsum([1 << b for b in BITS])])
SLOTS, CHUNK = int(OFFSET[-1]), 1 << 14
#: Tables double for each doubling of the training pairs beyond PAIRS, at most so often.
PAIRS, MOST_MORE = 1 << 23, 4
#: A gate for the counts of the word so far with its class (6 steps) and of three bytes (4 steps).
GATES, INPUTS, MAP = 24, len(BITS) + 1, 33
#: The gate's steps by a context's count.
_WORD_STEP = (np.digitize(np.arange(300), (1, 2, 4, 16, 256)) * 4).astype(np.int8)
_BYTES_STEP = np.digitize(np.arange(300), (1, 4, 32)).astype(np.int8)
_SALT = B.mix(np.arange(1, 8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def classes(low: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word and for each text's end: the class, below CLASSES, of the word before; 0 at a text's start."""
    n = len(start)
    own = np.zeros(n + 1, np.int64)  # of the words themselves, with a last one for "none"
    if n:
        own[:n] = 1 + (low[end - 1].astype(np.int64) + 3 * low[np.maximum(end - 2, start)]) % (CLASSES - 1)
    before = np.concatenate([[n], np.arange(n - 1)]) if n else np.zeros(0, np.int64)
    before[first[:-1][first[1:] > first[:-1]]] = n
    return own[before], np.where(first[1:] > first[:-1], own[np.maximum(first[1:] - 1, 0)], 0)


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, length, class and text of every token; a text's end has length 0."""
    low, start, end, first = B.words(data, at)
    n = len(at) - 1
    of_word, of_end = classes(low, start, end, first)
    doc = np.repeat(np.arange(n), np.diff(first))
    return low, np.concatenate([start, np.zeros(n, np.int64)]), np.concatenate([end - start, np.zeros(n, np.int64)]), np.concatenate([of_word, of_end]), np.concatenate([doc, np.arange(n)])


def keys(low: np.ndarray, start: np.ndarray, length: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """A 64-bit key of each (word, class)."""
    return B.mix(B.unit_hash(low, start, start + length) ^ _SALT[0] * (cls + 1).astype(np.uint64))


def _counted(batches: Iterator[pa.RecordBatch], most: int = 800_000) -> Iterator[pa.RecordBatch]:
    """word, class, train, held: how often each pair occurs in training texts and in others. Pairs are combined over many
    batches."""
    held: list[tuple] = []
    size = 0

    def combined() -> list[tuple]:
        key, word, cls, train, other = (np.concatenate(x) for x in zip(*held))
        unique, first, back = np.unique(key, return_index=True, return_inverse=True)
        return [(unique, word[first], cls[first], np.bincount(back, train).astype(np.int64), np.bincount(back, other).astype(np.int64))]

    def out() -> pa.RecordBatch:
        (_, word, cls, train, other), = combined()
        return pa.RecordBatch.from_arrays([pa.array(word.tolist(), pa.binary()), pa.array(cls, pa.int32()), pa.array(train), pa.array(other)], names=["word", "class", "train", "held"])

    for batch in B.pieces(batches, "text"):
        low, start, length, cls, doc = tokens(*B.utf8(batch.column(0)))
        train = batch.column(1).to_numpy(zero_copy_only=False)[doc]
        key = keys(low, start, length, cls)
        unique, first, back = np.unique(key, return_index=True, return_inverse=True)
        raw = low.tobytes()
        word = np.empty(len(first), object)
        word[:] = [raw[a : a + n] for a, n in zip(start[first].tolist(), length[first].tolist())]
        held.append((unique, word, cls[first], np.bincount(back, train).astype(np.int64), np.bincount(back, ~train).astype(np.int64)))
        size += len(unique)
        if size > most:
            held = combined()
            size = len(held[0][0])
            if size > most // 2:
                yield out()
                held, size = [], 0
    if held:
        yield out()


@dataclass
class Code:
    """A Huffman code of the 256 bytes: of each, where its path starts in node and bit, and its length. more: how often
    the tables were doubled."""

    at: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    more: int = 0

    @property
    def slots(self) -> int:
        return SLOTS << self.more


def huffman(counts: np.ndarray) -> Code:
    heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    new = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[2]], parent[b[2]] = (new, 0), (new, 1)
        heapq.heappush(heap, (a[0] + b[0], new, new))
        new += 1
    paths = []
    for s in range(256):
        path, x = [], s
        while x in parent:
            x, bit = parent[x]
            path.append((x - 256, bit))
        paths.append(path[::-1])
    length = np.array([len(p) for p in paths])
    flat = np.array([x for p in paths for x in p])
    return Code(np.cumsum(length) - length, length, flat[:, 0].astype(np.uint64), flat[:, 1])


def events(data: np.ndarray, at: np.ndarray, cls: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every bit of all words: its six table slots (one row each), the bit and its word's index."""
    n, size = len(at) - 1, np.diff(at)
    to = at + np.arange(n + 1)
    symbols = np.full(len(data) + n, END, np.uint8)
    word = np.repeat(np.arange(n), size + 1)
    here = np.arange(len(symbols))
    symbols[here < to[word + 1] - 1] = data
    place = here - to[word]
    wide = symbols.astype(np.uint64) + np.uint64(1)
    last = [np.zeros(len(symbols), np.uint64) for _ in range(3)]
    for k, x in enumerate(last, 1):
        x[k:] = wide[:-k]
        x[place < k] = 0
    sums = B.prefix(symbols)
    prefix = B.span_hash(sums, to[word], here)
    c = _SALT[6] * (cls[word] + 1).astype(np.uint64)
    two = last[0] | last[1] << np.uint64(9)
    contexts = [last[0], two, two | last[2] << np.uint64(18), prefix, prefix ^ c, two ^ c]
    bits = code.length[symbols]
    row = np.repeat(here, bits)
    k = np.arange(len(row)) - np.repeat(np.cumsum(bits) - bits, bits) + code.at[symbols][row]
    node = (code.node[k] + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
    slots = np.empty((len(BITS), len(row)), np.int32)
    for i, (x, b) in enumerate(zip(contexts, BITS)):
        slots[i] = ((B.mix(x ^ _SALT[i])[row] ^ node) * np.uint64(0xE7037ED1A0B428DB) >> np.uint64(64 - b - code.more)).astype(np.int32) + np.int32(OFFSET[i] << code.more)
    return slots, code.bit[k], word[row]


@dataclass
class Model:
    code: Code
    counts: np.ndarray  # 2 by code.slots: zeros and ones seen
    weights: np.ndarray  # GATES by INPUTS
    map: np.ndarray  # 2 by GATES by MAP: zeros and ones seen where the mix said so

    def __post_init__(self) -> None:
        self.counts = np.asfortranarray(self.counts)  # a slot's zeros and ones lie together and are read at once

    def seen(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The zeros and the ones of the slots."""
        both = np.ascontiguousarray(self.counts.T).view(np.complex64)[:, 0].take(slots, mode="clip")
        return both.real.copy(), both.imag.copy()


def inputs(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The predictors' logits, with a constant, and the gate of every bit."""
    x = np.empty((INPUTS, zeros.shape[1]), np.float32)
    np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)), out=x[:-1])
    x[-1] = 0.3
    most = np.float32(len(_WORD_STEP) - 1)
    gate = _WORD_STEP[np.minimum(zeros[4] + ones[4], most).astype(np.int16)] + _BYTES_STEP[np.minimum(zeros[2] + ones[2], most).astype(np.int16)]
    return x, gate.astype(np.intp)


def mixed(x: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    weights = weights.astype(np.float32)
    out = x[0] * weights[:, 0][gate]
    for j in range(1, INPUTS):
        out += x[j] * weights[:, j][gate]
    return np.clip(out, -12, 12)


def map_slot(logit: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(logit * 2) + MAP // 2, 0, MAP - 1).astype(np.int64)


def refined(logit: np.ndarray, gate: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The mean of the mix and of what its map entry saw."""
    p = 1 / (1 + np.exp(-logit))
    zeros, ones = table[0][gate, map_slot(logit)], table[1][gate, map_slot(logit)]
    return np.clip((p + (ones + 20 * p) / (zeros + ones + 20)) / 2, 1e-6, 1 - 1e-6)


def _without(zeros: np.ndarray, ones: np.ndarray, bit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counts without one occurrence of the bits themselves, where own says so; in place."""
    zeros -= own & (bit == 0)
    ones -= own & (bit == 1)
    return np.maximum(zeros, 0, out=zeros), np.maximum(ones, 0, out=ones)


def log10_probability(data: np.ndarray, at: np.ndarray, cls: np.ndarray, m: Model, train: np.ndarray | None = None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Of each word with its class before it. With train (counts of the words), also with one occurrence left out of the
    predictors' counts: two rows. wanted, of the same shape: which to compute; 0 stands for the others."""
    slots, bit, word = events(data, at, cls, m.code)
    n = len(at) - 1

    def summed(left_out: bool) -> np.ndarray:
        s, y, w = slots, bit, word
        if wanted is not None:
            on = np.flatnonzero(wanted[int(left_out)][word])
            s, y, w = slots.take(on, axis=1, mode="clip"), bit[on], word[on]
        zeros, ones = m.seen(s)
        if left_out:
            zeros, ones = _without(zeros, ones, y, train[w] > 0)
        x, gate = inputs(zeros, ones)
        p = refined(mixed(x, gate, m.weights), gate, m.map)
        return np.bincount(w, np.log10(np.where(y == 1, p, 1 - p)), minlength=n)

    return summed(False) if train is None else np.stack([summed(False), summed(True)])


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    for batch in B.pieces(batches, "word", 50_000):
        for i in range(0, batch.num_rows, 5_000):
            part = batch.slice(i, 5_000)
            data, at = B.utf8(part.column(part.schema.get_field_index("word")))
            get = lambda c: part.column(part.schema.get_field_index(c)).to_numpy()
            yield data, at, get("class").astype(np.int64), get("train"), part


def _table(batches: Iterator[pa.RecordBatch], code: Code) -> Iterator[pa.RecordBatch]:
    """One learner's counts, in chunks."""
    from pyspark import TaskContext

    counts = np.zeros((2, code.slots), np.float32)
    flat = counts.reshape(-1)
    for data, at, cls, train, _ in _word_batches(batches):
        slots, bit, word = events(data, at, cls, code)
        weight, by_bit = train.astype(np.float32)[word], (bit * code.slots).astype(np.int32)
        for row in slots:
            np.add.at(flat, row + by_bit, weight)
    part = TaskContext.get().partitionId()
    for k in range(-(-code.slots // CHUNK)):
        piece = counts[:, k * CHUNK : (k + 1) * CHUNK]
        if piece.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([piece.tobytes()], pa.binary())], names=["chunk", "part", "counts"])


def _summed(parts: DataFrame, n: int, fan: int = 64) -> DataFrame:
    """Sums the learners' chunks along a tree of at most `fan` inputs a step."""

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float32) for x in table.column("counts").to_pylist()], axis=0, dtype=np.float32)
        return pa.table({"chunk": table.column("chunk")[:1], "part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    while n > 1:
        n = -(-n // fan)
        parts = parts.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("chunk", "part").applyInArrow(add, "chunk int, part int, counts binary")
    return parts


def _learn(batches: Iterator[pa.RecordBatch], m: Model, block: int = 1 << 12) -> Iterator[pa.RecordBatch]:
    """Mixing weights learned online and the map's counts; each bit's own token is left out of the predictors."""
    weights, table, mass = m.weights.copy(), np.zeros_like(m.map), np.zeros(GATES)
    for data, at, cls, train, _ in _word_batches(batches):
        slots, bit, word = events(data, at, cls, m.code)
        for i in range(0, len(bit), block):
            b = slice(i, i + block)
            y = bit[b]
            x, gate = inputs(*_without(*m.seen(slots[:, b]), y, np.True_))
            w = train[word[b]].astype(float)
            logit = mixed(x, gate, weights)
            error = (y - 1 / (1 + np.exp(-logit))) * w
            total = np.bincount(gate, w, minlength=GATES)
            for j in range(INPUTS):
                weights[:, j] += 0.3 * np.bincount(gate, error * x[j], minlength=GATES) / np.maximum(total, 1e-9) * np.minimum(total / 200, 1)
            mass += total
            flat = gate * MAP + map_slot(logit)
            for v in (0, 1):
                table[v] += np.bincount(flat[y == v], w[y == v], minlength=GATES * MAP).reshape(GATES, MAP)
    values = np.concatenate([(weights * mass[:, None]).ravel(), mass, table.ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["i", "value"])


def fit(words: DataFrame, learners: int, more: int = 0) -> Model:
    """words: word, class, train; pairs that do not occur in training texts teach nothing."""
    spark, words = words.sparkSession, words.where("train > 0")

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256)
        for data, at, _, train, _ in _word_batches(batches):
            total += np.bincount(data, np.repeat(train, np.diff(at)), minlength=256)
            total[END] += train.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(total)], names=["i", "value"])

    def gathered(df: DataFrame, n: int) -> np.ndarray:
        out = np.zeros(n)
        for r in df.groupBy("i").agg(F.sum("value").alias("value")).collect():  # n rows
            out[r["i"]] = r["value"]
        return out

    code = huffman(gathered(words.mapInArrow(histogram, "i int, value double"), 256))
    code.more = more
    learning = words.coalesce(learners)
    parts = learning.mapInArrow(lambda it: _table(it, code), "chunk int, part int, counts binary")
    counts = np.zeros((2, code.slots), np.float32)
    for r in _summed(parts, learners).toLocalIterator():  # the tables, of bounded size
        piece = np.frombuffer(r["counts"], np.float32).reshape(2, -1)
        counts[:, r["chunk"] * CHUNK : r["chunk"] * CHUNK + piece.shape[1]] += piece
    start = Model(code, counts, np.full((GATES, INPUTS), 0.25), np.zeros((2, GATES, MAP)))
    sent = spark.sparkContext.broadcast(start)
    found = gathered(words.mapInArrow(lambda it: _learn(it, sent.value), "i int, value double"), GATES * INPUTS + GATES + 2 * GATES * MAP)
    mass = found[GATES * INPUTS : GATES * INPUTS + GATES]
    weights = np.where(mass[:, None] > 0, found[: GATES * INPUTS].reshape(GATES, INPUTS) / np.maximum(mass[:, None], 1e-9), start.weights)
    return Model(code, counts, weights, found[GATES * INPUTS + GATES :].reshape(2, GATES, MAP))


def training(id: str) -> Column:
    """True for the ids to learn from: crc32 of the id as text, modulo 7, is not 2."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 7 != 2, F.lit(True))


def score(df: DataFrame, id: str = "doc_id", text: str = "text", frequent: int = 1 << 20) -> DataFrame:
    """One row for each row of df: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = df.sparkSession
    body = F.coalesce(F.col(quoted(text)), F.lit("")).alias("text")
    rows = df.select(body, training(quoted(id)).alias("train"), F.col(quoted(id)).alias("id"))
    counted = rows.select("text", "train").mapInArrow(_counted, "word binary, class int, train long, held long")
    # Rows were combined in the tasks, so a frequent word has a few rows from each.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_word = Window.partitionBy("word")
    words = counted.repartition(partitions, "word").groupBy("word", "class").agg(F.sum("train").alias("train"), F.sum("held").alias("held"))
    words = words.withColumn("c", F.sum("train").over(by_word)).withColumn("new", F.min(F.when(F.col("train") > 0, F.col("class"))).over(by_word).eqNullSafe(F.col("class")))
    words = written(words)
    release(spark)
    n, v, pairs = (x or 0 for x in words.agg(F.sum("train"), F.sum(F.col("new").cast("int")), F.sum((F.col("train") > 0).cast("int"))).first())
    more = min(max((pairs // PAIRS).bit_length(), 0), MOST_MORE)
    learners = max(1, min(partitions, n // 8_000_000 + 1))
    model = spark.sparkContext.broadcast(fit(words.select("word", "class", "train"), learners, more))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, at, cls, train, part in _word_batches(batches):
            get = lambda c: part.column(part.schema.get_field_index(c))
            wanted = np.stack([get("held").to_numpy() > 0, train > 0])
            p, q = log10_probability(data, at, cls, model.value, train, wanted).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(keys(data, at[:-1], np.diff(at), cls).view(np.int64)), get("c"), pa.array(p), pa.array(q), pa.array(train)], names=["key", "c", "p", "q", "train"])

    # p is for texts that were not learned from, q for those that were.
    table = written(words.drop("new").mapInArrow(scored, "key long, c long, p float, q float, train long"))
    # The least count of which no more than `frequent` pairs have as much, from a histogram by eighths of powers of two.
    step = F.floor(8 * F.log2(F.col("train"))).cast("int")
    sizes = table.where("train > 0").groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()  # at most 512 rows
    least, have = 1 << 20, 0
    for r in sizes:
        if have + r["n"] > frequent:
            break
        least, have = r["step"], have + r["n"]
    top = table.where((F.col("train") > 0) & (step >= least)).select("key", "c", "p", "q").toArrow()  # at most `frequent` rows
    order = np.argsort(top.column("key").to_numpy())
    known = spark.sparkContext.broadcast((top.column("key").to_numpy()[order], top.column("c").to_numpy()[order], np.stack([top.column(x).to_numpy()[order] for x in "pq"])))
    divisor = float(n + v + 1)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's sums over the broadcast pairs, and the keys of its other tokens."""
        top_key, top_c, top_p = known.value
        for batch in B.pieces(batches, "text"):
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            total, (data, at) = batch.num_rows, B.utf8(get("text"))
            low, start, length, cls, doc = tokens(data, at)
            key = keys(low, start, length, cls).view(np.int64)
            i = np.minimum(np.searchsorted(top_key, key), max(len(top_key) - 1, 0))
            hit = top_key[i] == key if len(top_key) else np.zeros(len(key), bool)
            train = get("train").to_numpy(zero_copy_only=False)
            off = np.flatnonzero(~hit)
            off = off[np.argsort(doc[off], kind="stable")]
            rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[off], np.arange(total + 1)), pa.int32()), pa.array(key[off]))
            i, on = i[hit], doc[hit]
            each = lambda x: pa.array(np.bincount(on, x, minlength=total))
            whole = lambda x: pa.array(np.bincount(doc, x, minlength=total).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [get("id"), get("train"), pa.array(np.diff(at)), whole(None), whole(length + 1), each(top_c[i] > 0).cast(pa.int64()), each(np.log10((top_c[i] + 1) / divisor)), each(top_p[train[on].astype(np.int8), i]), rest],
                names=["id", "train", "n_bytes", "n_tokens", "coded", "n_known", "base", "p", "rest"],
            )

    made = T._parse_datatype_string("train boolean, n_bytes long, n_tokens long, coded long, n_known long, base double, p double, rest array<long>").fields
    texts = numbered(rows.mapInArrow(looked_up, T.StructType([T.StructField("id", rows.schema["id"].dataType), *made])), "row")
    release(spark)
    rest = texts.select("row", F.col("train").alias("learned"), F.explode("rest").alias("key")).join(table.drop("train"), "key")
    rest = rest.groupBy("row").agg(F.sum((F.col("c") > 0).cast("int")).alias("k2"), F.sum(F.log10((F.col("c") + 1) / F.lit(divisor))).alias("b2"), F.sum(F.when(F.col("learned"), F.col("q")).otherwise(F.col("p"))).alias("p2"))
    both = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    out = texts.drop("rest").join(rest, "row", "left").withColumn("score", both("p", "p2"))
    return out.select(
        F.col("id").alias(id), (~F.col("train")).alias("held_out"), "n_tokens", both("n_known", "k2").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), both("base", "b2").alias("base_score"), "score", "n_bytes",
        F.when(F.col("n_bytes") > 0, -F.col("score") * F.lit(float(np.log2(10))) / F.col("coded")).alias("bits_per_byte"),
    )
