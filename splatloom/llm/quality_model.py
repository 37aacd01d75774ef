"""Quality classifier: ordinal cumulative-link regression over hashed text.

One weight vector is shared by all grades: a text's score ``s`` is the sum of its features' weights,
and P(grade >= k) = sigmoid(s - t_k) with ordered thresholds t_1 < t_2 < ...  Features are hashed
words (by presence), hashed word beginnings (by percentage of the words), hashed patterns of symbols
around words (by share of the tokens), and classes of capitals and of distinct words.  The expected grade ranks texts and P(grade = top) selects them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import small_batches
from .text import ALNUM, NOT_SPACE, buffers, chunks, mix, seeded, word_hashes, words

#: Rated documents in the mean that the model is fitted on.
SAMPLE_ROWS = 8_000
_SHARES = 1 << 30
#: Least probability of the top grade for a document to be kept.
TAIL = 0.7
WORD_SLOTS, BEGIN_SLOTS, SYMBOL_SLOTS, CLASSES = 1 << 18, 1 << 16, 1 << 12, 32
SLOTS = WORD_SLOTS + BEGIN_SLOTS + SYMBOL_SLOTS + CLASSES
BEGIN_BYTES = 6
STEPS, RATE, DECAY = 250, 0.05, 1e-4
#: A feature is used if at least so many rated documents have it and its score statistic is so far from 0.
LEAST_DOCS, LEAST_SCORE = 5, 6.0

_SYMBOLS = np.where(ALNUM | ~NOT_SPACE, np.uint64(0), seeded(np.arange(256, dtype=np.uint64), 31))
_BYTES = np.arange(256)
_UPPER = ((_BYTES >= 65) & (_BYTES <= 90)).astype(np.int64)
_LOWER = ((_BYTES >= 97) & (_BYTES <= 122)).astype(np.int64)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of all features of the texts, in order of row; texts without a word have none."""
    n = len(offsets) - 1
    start, end, first = words(raw, offsets, ALNUM)
    row = np.repeat(np.arange(n), np.diff(first))
    slot = (word_hashes(raw, start, end) & np.uint64(WORD_SLOTS - 1)).astype(np.int64)
    present = np.unique(row * SLOTS + slot)
    distinct = np.bincount(present // SLOTS, minlength=n)
    slot = WORD_SLOTS + (word_hashes(raw, start, np.minimum(end, start + BEGIN_BYTES)) & np.uint64(BEGIN_SLOTS - 1)).astype(np.int64)
    begun, count = np.unique(row * SLOTS + slot, return_counts=True)
    percent = np.minimum(4.0, 100.0 * count / np.diff(first)[begun // SLOTS])

    start, end, first = words(raw, offsets, NOT_SPACE)
    tokens = np.diff(first)
    row = np.repeat(np.arange(n), tokens)
    total = np.append(np.uint64(0), np.cumsum(_SYMBOLS[raw]))
    around = mix(total[end] - total[start])
    slot = WORD_SLOTS + BEGIN_SLOTS + (around & np.uint64(SYMBOL_SLOTS - 1)).astype(np.int64)
    pattern, count = np.unique(row * SLOTS + slot, return_counts=True)
    share = 4.0 * count / tokens[pattern // SLOTS]

    up, low = np.append(0, np.cumsum(_UPPER[raw])), np.append(0, np.cumsum(_LOWER[raw]))
    shouted = np.bincount(row, weights=(up[end] - up[start] > 1) & (low[end] == low[start]), minlength=n)
    full = np.flatnonzero(tokens)
    rare = np.minimum(15, 16 * distinct[full] // np.maximum(tokens[full], 1))
    loud = 16 + np.minimum(15, 16 * shouted[full] // tokens[full]).astype(np.int64)
    base = full * SLOTS + SLOTS - CLASSES
    keys = np.concatenate([present, begun, pattern, base + rare, base + loud])
    values = np.concatenate([np.ones(len(present)), percent, share, np.ones(2 * len(full))]).astype(np.float32)
    order = np.argsort(keys, kind="stable")
    return keys[order] // SLOTS, keys[order] % SLOTS, values[order]


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = buffers(batch.column(1))
        for a, b in chunks(offsets, 1 << 20):
            row, slot, value = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            at = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(at, pa.array(slot.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(value))], ["grade", "slots", "values"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    """Weights and thresholds; ``tail`` gives P(grade >= k) for k = 1 .. top."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tail(self, score: np.ndarray) -> np.ndarray:
        return _sigmoid(score[:, None] - self.thresholds)

    def scores(self, row: np.ndarray, slot: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, weights=self.weights[slot] * value, minlength=n)


def telling(row: np.ndarray, slot: np.ndarray, value: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """The slots whose features go with the grade: a score test of each against no weights at all."""
    rest = grade - grade.mean()
    total = np.bincount(slot, weights=value, minlength=SLOTS)
    score = np.bincount(slot, weights=value * rest[row], minlength=SLOTS)
    squares = np.bincount(slot, weights=value.astype(np.float64) ** 2, minlength=SLOTS)
    spread = np.sqrt(np.maximum(squares - total**2 / len(grade), 1e-12) * rest.var())
    return (np.bincount(slot, minlength=SLOTS) >= LEAST_DOCS) & (np.abs(score) >= LEAST_SCORE * spread)


def fit(row: np.ndarray, slot: np.ndarray, value: np.ndarray, grade: np.ndarray, top: int) -> OrdinalModel:
    """Maximum likelihood over the telling features, by Adam over all rows in each step, with weight decay."""
    n = len(grade)
    kept = telling(row, slot, value, grade)[slot]
    row, value = row[kept], value[kept]
    used, slot = np.unique(slot[kept], return_inverse=True)
    theta = np.concatenate([np.zeros(len(used)), np.linspace(-1, 1, top)[:1], np.zeros(top - 1)])
    m, v, w = np.zeros_like(theta), np.zeros_like(theta), len(used)
    at = np.arange(n)
    for step in range(1, STEPS + 1):
        gaps = np.exp(theta[w + 1 :])
        cuts = np.concatenate([[-np.inf], np.cumsum(np.concatenate([theta[w : w + 1], gaps])), [np.inf]])
        score = np.bincount(row, weights=theta[slot] * value, minlength=n)
        above, below = _sigmoid(cuts[grade + 1] - score), _sigmoid(cuts[grade] - score)
        chance = np.maximum(above - below, 1e-9)
        up, down = above * (1 - above) / chance, below * (1 - below) / chance  # d log-likelihood by the cuts
        by_cut = np.zeros((n, top + 2))
        by_cut[at, grade + 1] -= up
        by_cut[at, grade] += down
        by_cut = by_cut.mean(axis=0)[1:-1]
        grad = np.empty_like(theta)
        grad[:w] = np.bincount(slot, weights=((up - down) / n)[row] * value, minlength=w) + DECAY * theta[:w]
        tails = np.cumsum(by_cut[::-1])[::-1]
        grad[w] = tails[0]
        grad[w + 1 :] = tails[1:] * gaps
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(SLOTS, np.float32)
    weights[used] = theta[:w]
    return OrdinalModel(weights, np.cumsum(np.concatenate([theta[w : w + 1], np.exp(theta[w + 1 :])])))


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample_rows: int = SAMPLE_ROWS) -> OrdinalModel | None:
    """Fit on about ``sample_rows`` rated documents, drawn by a hash of the id; None if fewer than two grades are rated.

    Grades are whole numbers from 0; a document rated more than once has its lowest grade, and so have
    documents of the same text.  The fit doesn't depend on the order or the partitions of the tables.
    """
    small_batches(docs.sparkSession)
    rated = ratings.select(F.col(id_col).alias("__rated"), F.col(grade_col).cast("int").alias("__grade")).dropna().groupBy("__rated").agg(F.min("__grade").alias("__grade"))
    share = -(-sample_rows * _SHARES // max(1, ratings.count()))
    sample = rated.where(F.pmod(F.xxhash64("__rated"), F.lit(_SHARES)) < share)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("__id") == F.col("__rated"))
    # Copies count once, with their lowest grade; in the order of the texts, so that reruns fit the same model.
    texts = texts.groupBy("text").agg(F.min("__grade").alias("__grade")).select("__grade", "text").orderBy("text")
    table = texts.mapInArrow(_features_of, "grade int, slots array<int>, values array<float>").toArrow()
    grade = table.column("grade").to_numpy()
    if len(np.unique(grade)) < 2:
        return None
    slots, values = table.column("slots").combine_chunks(), table.column("values").combine_chunks()
    row = np.repeat(np.arange(len(grade)), np.diff(slots.offsets.to_numpy()))
    return fit(row, slots.flatten().to_numpy(), values.flatten().to_numpy(), grade, int(grade.max()))


def _graded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            for a, b in chunks(offsets, 1 << 20):
                row, slot, value = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                tail = model.tail(model.scores(row, slot, value, b - a))
                tail[np.bincount(row, minlength=b - a) == 0] = 0  # nothing to read
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(tail.sum(axis=1)), pa.array(tail[:, -1])], ["doc_id", "expected_grade", "top_probability"])

    return run


def grades(docs: DataFrame, model: OrdinalModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, top_probability, kept) for every row of ``docs``.

    A text without any word, or null, has grade and probability 0 and is not kept.  Without a model
    both are null and every row is kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return base.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("top_probability"), F.lit(True).alias("kept"))
    kind = base.schema["doc_id"].dataType.simpleString()
    out = base.mapInArrow(_graded(spark.sparkContext.broadcast(model)), f"doc_id {kind}, expected_grade double, top_probability double")
    return out.withColumn("kept", F.col("top_probability") >= TAIL)


def ratings_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of 0/1 labels: quality plus 1 if not toxic, so 2 is good and harmless."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))


def _keep(shared, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            graded = pa.RecordBatch.from_arrays([batch.column(text), batch.column(text)], ["doc_id", "text"])
            tails = [x for out in _graded(shared)(iter([graded])) for x in [out.column(2)]]
            if tails:
                yield batch.filter(pa.array(np.concatenate([x.to_numpy() for x in tails]) >= TAIL))

    return run


def selected(docs: DataFrame, model: OrdinalModel | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``grades`` keeps, with their columns; no shuffle."""
    if model is None:
        return docs
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)), docs.schema)
