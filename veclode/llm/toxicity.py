"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

fit draws at most `most_labels` labelled rows (by a hash of the id, so the sample is a documented bound
and is the same on every run), learns a lexicon of words and five-byte word beginnings from them (the
ones that toxic rows use far more often, at most `most_words`), computes dense features and fits Spark's
gradient-boosted trees; rows of the calibration fold fit an isotonic curve from the trees' probability
to the label rate. score applies both to every whole text. Features see only the text.

Definitions: a null text is an empty text; labels that are null are left out, and several labels of one
id count as toxic if one of them is; labels without a document are left out; without labels, or with one
class only, the score is the share of toxic labels (0 if there are none), which a text without words never
exceeds; repeated rows score alike; an
empty table gives an empty table; other columns pass through, and `score` and `predicted` replace
columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .store import map_in_arrow, quoted, written

#: Words of the second person.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos "
    "ti tus usted ustedes vosotros"
).split()
#: Characters that stand for letters in disguised words.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "*"}
FEATURES = ("words", "hits", "density", "weight", "beginnings", "disguised", "address", "capitals", "shouted", "punctuation", "exclamations", "mixed")
NEAR = 5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in LEET.items():
    _LEET[ord(_a)] = ord(_b)
_IS_LEET = np.zeros(256, bool)
_IS_LEET[[ord(c) for c in LEET]] = True
_EDGE = _LETTER | _IS_LEET  # what a disguised word may start and end with
_EDGE[[ord("!"), ord("*")]] = False
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def lower(data: np.ndarray) -> np.ndarray:
    """Lower-cased UTF-8 bytes: A-Z and the Latin-1 capitals."""
    low = B._LOWER[data]
    if len(data) > 1:
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        low[capital] += 0x20
    return low


def _word_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of the first five bytes of those that are longer (else 0)."""
    begin = np.where(end - start > 5, B.unit_hash(low, start, np.minimum(start + 5, end)) ^ np.uint64(1), np.uint64(0))
    return B.unit_hash(low, start, end), begin


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct word hashes, with its label."""
    for batch in B.pieces(batches, "text"):
        data, at = B.utf8(batch.column(0))
        _, start, end, first = B.words(data, at, ~_LETTER)
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
        word, begin = _word_hashes(lower(data), start, end)
        both = np.concatenate([word, begin])
        rows = np.stack([np.concatenate([doc, doc]).astype(np.uint64), both], axis=1)[both != 0]
        if not len(rows):
            continue
        rows = np.unique(rows, axis=0) if len(rows) < 1000 else _unique_rows(rows)
        label = toxic[rows[:, 0].astype(np.int64)].astype(np.int64)
        keys, back = np.unique(rows[:, 1], return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(np.bincount(back, label).astype(np.int64)), pa.array(np.bincount(back, 1 - label).astype(np.int64))], names=["word", "toxic", "clean"]
        )


def _unique_rows(rows: np.ndarray) -> np.ndarray:
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return rows[new]


def features(data: np.ndarray, at: np.ndarray, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The FEATURES of each text (one row each). words: the lexicon's sorted hashes."""
    n = len(at) - 1
    low = lower(data)
    _, start, end, first = B.words(data, at, ~_LETTER)
    doc = np.repeat(np.arange(n), np.diff(first))
    count = np.diff(first).astype(float)
    per = np.maximum(count, 1)
    each = lambda x, d=doc: np.bincount(d, x, minlength=n)

    def look(hashes: np.ndarray) -> np.ndarray:
        if not len(words):
            return np.zeros(len(hashes))
        i = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
        return np.where(words[i] == hashes, weights[i], 0.0)

    word, begin = _word_hashes(low, start, end)
    weight, weight_begin = look(word), look(begin)
    hit = weight > 0
    # Second person within NEAR words of a hit, in the same text.
    you = np.isin(word, SECOND)
    seen = np.concatenate([[0], np.cumsum(you)])
    a, b = np.maximum(np.arange(len(word)) - NEAR, first[doc]), np.minimum(np.arange(len(word)) + NEAR + 1, first[doc + 1])
    near = hit & (seen[b] > seen[a])
    # Disguised words: letters mixed with signs that stand for letters.
    plain = _LETTER | _IS_LEET
    _, s2, e2, f2 = B.words(data, at, ~plain)
    doc2 = np.repeat(np.arange(n), np.diff(f2))
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    some = letters[e2] - letters[s2]
    inside = (some > 0) & (some < e2 - s2) & _EDGE[data[s2]] & _EDGE[data[np.maximum(e2 - 1, 0)]] if len(s2) else np.zeros(0, bool)
    masked = look(B.unit_hash(_LEET[low], s2[inside], e2[inside])) > 0
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    upper = (data >= 65) & (data <= 90)
    n_letters, n_upper, size = total(_LETTER[data]), total(upper), np.maximum(np.diff(at), 1)
    capitals = np.concatenate([[0], np.cumsum(upper)])
    shouted = (capitals[end] - capitals[start] == end - start) & (end - start > 2)
    columns = [
        np.log1p(count), each(hit), each(hit) / per, each(weight) / per, each(weight_begin > 0) / per, each(masked.astype(float), doc2[inside]) / per, each(near) / per,
        n_upper / np.maximum(n_letters, 1), each(shouted) / per, total(_PUNCTUATION[data]) / size, total(data == 33) / size, each(inside, doc2) / per,
    ]
    return np.stack(columns, axis=1)


def _second() -> np.ndarray:
    raw = [w.encode() for w in SECOND_PERSON]
    ends = np.cumsum([len(w) for w in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    return B.unit_hash(data, ends - [len(w) for w in raw], ends)


SECOND = _second()


def fold(id: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % folds


@dataclass
class Model:
    words: np.ndarray
    weights: np.ndarray
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    rate: float


def with_features(df: DataFrame, words: np.ndarray, weights: np.ndarray, text: str = "text") -> DataFrame:
    """df with __features array<double>."""
    schema = T.StructType([*df.schema.fields, T.StructField("__features", T.ArrayType(T.DoubleType()))])
    both = df.sparkSession.sparkContext.broadcast((words, weights))  # at most most_words of each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.pieces(batches, text):
            data, at = B.utf8(batch.column(batch.schema.get_field_index(text)))
            x = features(data, at, *both.value)
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "__features"])

    return map_in_arrow(df, run, schema)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", most_labels: int = 20000, most_words: int = 4000, min_support: int = 3, trees: int = 20, depth: int = 3, calibration_fold: int = 1) -> Model:
    """Learns from the labels given (leave held-out rows out of `labels`)."""
    labels = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(id).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    n = labels.count()
    if n > most_labels:  # hashes are even, so about most_labels rows stay
        labels = labels.where(F.xxhash64(id) < int(most_labels / n * 2**64) - 2**63)
    # At most about most_labels rows, so they are broadcast and no text is shuffled.
    rows = docs.select(F.col(id), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(labels), id)
    rows = written(rows.select("text", "toxic", fold(id).alias("fold")))
    n_rows, n_toxic = rows.agg(F.count("*"), F.sum("toxic")).first()
    none = np.zeros(0, np.uint64), np.zeros(0)
    if not n_rows or not n_toxic or n_toxic == n_rows:
        return Model(*none, None, None, (n_toxic or 0) / n_rows if n_rows else 0.0)
    counts = rows.select("text", "toxic").mapInArrow(_word_rows, "word long, toxic long, clean long")
    counts = counts.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(F.col("t") >= min_support)
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_rows - n_toxic + 1))
    # Far more often in toxic rows: at least e**2 times, by three standard errors.
    strong = counts.withColumn("odds", odds).where((F.col("odds") > 2) & (F.col("odds") > 3 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))))
    found = strong.orderBy(F.desc("odds"), "word").limit(most_words).select("word", "odds").toArrow()
    words, weights = found.column("word").to_numpy().view(np.uint64), found.column("odds").to_numpy()
    order = np.argsort(words)
    words, weights = words[order], weights[order]
    table = written(with_features(rows, words, weights).select(array_to_vector("__features").alias("features"), F.col("toxic").cast("double").alias("label"), (F.col("fold") == calibration_fold).alias("calibrate")).coalesce(8))
    grown = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=1, minInstancesPerNode=3).fit(table.where(~F.col("calibrate")))
    held = grown.transform(table.where("calibrate")).select("label", vector_to_array("probability")[1].alias("p"))
    n_held = held.agg(F.count("*"), F.sum("label")).first()
    curve = None
    if n_held[0] and 0 < n_held[1] < n_held[0]:
        curve = IsotonicRegression(featuresCol="p", labelCol="label").fit(held)
    return Model(words, weights, grown, curve, n_toxic / n_rows)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score double (0 to 1, higher: more likely toxic) and predicted int."""
    kept = docs.drop("score", "predicted")
    if model.trees is None:
        out = kept.withColumn("score", F.lit(float(model.rate)))
    else:
        rows = with_features(kept, model.words, model.weights, text)
        rows = rows.withColumns({"__vector": array_to_vector("__features"), "__wordless": F.col("__features")[0] == 0}).drop("__features")
        trees = model.trees.copy().setFeaturesCol("__vector").setPredictionCol("__tree").setProbabilityCol("__p").setRawPredictionCol("__raw")
        rows = trees.transform(rows).withColumn("__p1", vector_to_array("__p")[1])
        value = F.col("__p1")
        if model.curve is not None:
            rows = model.curve.copy().setFeaturesCol("__p1").setPredictionCol("__curve").transform(rows)
            value = 0.98 * F.col("__curve") + 0.02 * F.col("__p1")  # the curve has steps; the trees order the rows within one
        value = F.when(F.col("__wordless"), F.least(value, F.lit(float(model.rate)))).otherwise(value)
        out = rows.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))).select(*map(quoted, kept.columns), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
