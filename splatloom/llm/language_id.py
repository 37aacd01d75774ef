"""Language identification by prediction by partial matching (PPM).

Each language has a context tree of its own over the last ``ORDER`` bytes, which counts the bytes
that follow each context of 0 to ``ORDER`` bytes.  A byte's probability comes from the longest
context that the tree knows; a byte not seen there costs an escape (method C: distinct symbols over
total plus distinct) to the next shorter context, with the symbols already ruled out excluded, down
to a uniform choice.  No context is left out, whatever its count.  The statistics are frozen after
training, so a byte's code length depends on nothing but the bytes before it, and a text's language
is the one with the shortest code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import small_batches, written
from .text import buffers

ORDER = 3
#: Documents, and bytes of text, of each language, in the mean, that its tree is learned from.
SAMPLE_DOCS, SAMPLE_BYTES = 2_000, 8 << 20
#: Bytes of text looked at together, and code lengths that a worker keeps for later texts.
SLICE, KEPT = 1 << 20, 1 << 22
#: Languages, and rows of their trees, that are scored together (or one language); a model may have any number of such blocks.
BLOCK_LANGUAGES, BLOCK_GRAMS = 64, 4 << 20
_SHARES = 1 << 20


def grams(raw: np.ndarray, offsets: np.ndarray, a: int, b: int) -> np.ndarray:
    """Each byte of ``raw[a:b]`` with the ``ORDER`` bytes before it in higher places; 0 before the start of its text."""
    out = raw[a:b].astype(np.int64)
    for k in range(1, ORDER + 1):
        past = raw[max(0, a - k) : b - k] if b > k else raw[:0]
        out[b - a - len(past) :] |= past.astype(np.int64) << 8 * k
    starts = offsets[np.searchsorted(offsets, a - ORDER) : np.searchsorted(offsets, b)]
    for j in range(ORDER):
        at = starts + j - a
        at = at[(at >= 0) & (at < b - a)]
        out[at] &= (1 << 8 * (j + 1)) - 1
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of the texts of each batch."""
    for batch in batches:
        names, index = np.unique(np.array(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
        raw, offsets = buffers(batch.column(1))
        owner = np.repeat(index, np.diff(offsets))
        for a in range(0, len(raw), SLICE):
            b = min(a + SLICE, len(raw))
            found = grams(raw, offsets, a, b)
            for k, name in enumerate(names):
                gram, n = np.unique(found[owner[a:b] == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted ``keys`` hold each wanted one, and whether they do."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Tree:
    """One language's contexts of every order, with what follows them."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.seen, self.n, self.contexts, self.total, self.distinct = [], [], [], [], []
        #: What a context's symbols count in its parent, the context one byte shorter: ruled out there after an escape.
        self.ruled = []
        for k in range(ORDER + 1):
            seen, index = np.unique(gram & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            counts = np.bincount(index, weights=n)
            contexts, own = np.unique(seen >> 8, return_inverse=True)
            self.ruled.append(np.bincount(own, weights=self.n[-1][_places(self.seen[-1], seen & ((1 << 8 * k) - 1))[0]]) if k else np.zeros(1))
            self.seen.append(seen)
            self.n.append(counts)
            self.contexts.append(contexts)
            self.total.append(np.bincount(own, weights=counts))
            self.distinct.append(np.bincount(own).astype(float))

    def code_lengths(self, gram: np.ndarray) -> np.ndarray:
        """-log2 P(last byte | bytes before it) of each gram."""
        bits = np.zeros(len(gram))
        open_ = np.ones(len(gram), bool)
        ruled, gone = np.zeros(len(gram)), np.zeros(len(gram))  # of the longer context
        for k in range(ORDER, -1, -1):
            live = np.flatnonzero(open_)
            own = gram[live] & ((1 << 8 * (k + 1)) - 1)
            context, known = _places(self.contexts[k], own >> 8)
            live, own, context = live[known], own[known], context[known]
            distinct = self.distinct[k][context] - gone[live]
            whole = self.total[k][context] - ruled[live] + distinct
            symbol, hit = _places(self.seen[k], own)
            chance = np.where(hit, self.n[k][symbol], distinct) / np.maximum(whole, 1)
            bits[live[whole > 0]] -= np.log2(chance[whole > 0])
            open_[live[hit]] = False
            ruled[live], gone[live] = self.ruled[k][context], self.distinct[k][context]
        rest = np.flatnonzero(open_)
        bits[rest] += np.log2(np.maximum(256 - gone[rest], 1))
        return bits


class PPM:
    """The trees of all languages, and the code lengths that were asked for so far."""

    def __init__(self, langs: np.ndarray, trees: list[Tree]):
        self.langs, self.trees = langs, trees
        self._known, self._bits = np.zeros(0, np.int64), np.zeros((len(trees), 0), np.float32)

    def _lookup(self, gram: np.ndarray) -> np.ndarray:
        """Code lengths [languages, grams] of distinct grams."""
        known = _places(self._known, gram)[1] if len(self._known) else np.zeros(len(gram), bool)
        if not known.all():
            fresh = gram[~known]
            if (len(self._known) + len(fresh)) * len(self.trees) > KEPT:
                self._known, self._bits, fresh = self._known[:0], self._bits[:, :0], gram
            keys = np.concatenate([self._known, fresh])
            order = np.argsort(keys, kind="stable")
            bits = np.stack([t.code_lengths(fresh) for t in self.trees]).astype(np.float32)
            self._known, self._bits = keys[order], np.concatenate([self._bits, bits], axis=1)[:, order]
        at = np.searchsorted(self._known, gram)
        return self._bits[:, at]

    def code_lengths(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(offsets) - 1, len(self.trees)))
        row = np.flatnonzero(np.diff(offsets))
        for a in range(0, len(raw), SLICE):
            b = min(a + SLICE, len(raw))
            own = row[(offsets[row] < b) & (offsets[row + 1] > a)]
            gram, index = np.unique(grams(raw, offsets, a, b), return_inverse=True)
            for k, bits in enumerate(self._lookup(gram)):
                out[own, k] += np.add.reduceat(bits[index], np.maximum(offsets[own], a) - a, dtype=np.float64)
        return out


@dataclass
class Model:
    """A written table of (block, lang, gram, n) and the number of its blocks; only one block's trees are held at a time."""

    table: DataFrame
    blocks: int

    def block(self, k: int) -> PPM:
        rows = self.table.where(F.col("block") == k).select("lang", "gram", "n").toArrow()
        langs, lang = np.unique(np.array(rows.column("lang").to_pylist()), return_inverse=True)
        gram, n = rows.column("gram").to_numpy(), rows.column("n").to_numpy().astype(float)
        return PPM(langs, [Tree(gram[lang == k], n[lang == k]) for k in range(len(langs))])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Learn from texts of each language, drawn by a hash of the id; None without any.

    A language's sample has ``sample_docs`` texts and ``sample_bytes`` bytes in the mean at most, which bounds
    its tree.  Languages, in order of their name, fall into blocks of BLOCK_LANGUAGES and BLOCK_GRAMS rows at most (or one
    language), so there may be any number of them.
    """
    small_batches(docs.sparkSession)
    learned = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and id is not null and text <> ''")
    sizes = learned.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    sizes = written(sizes, "languages")
    share = F.least(sample_docs / F.col("n"), sample_bytes / F.col("bytes")) * _SHARES
    # A few bytes for each language; beyond a few million of them, Spark joins them in another way.
    sizes = F.broadcast(sizes) if sizes.count() <= 1 << 20 else sizes
    sample = learned.join(sizes, "lang").where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(_SHARES)) < F.ceil(share))
    table = written(sample.select("lang", "text").mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    # One row for each language.
    order = Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)
    place = F.greatest(F.floor(F.count("*").over(order) / BLOCK_LANGUAGES), F.floor(F.coalesce(F.sum("rows").over(order), F.lit(0)) / BLOCK_GRAMS))
    langs = table.groupBy("lang").agg(F.count("*").alias("rows")).select("lang", place.alias("block"))
    blocks = written(langs.withColumn("block", F.dense_rank().over(Window.orderBy("block")) - 1), "blocks")
    n = blocks.agg(F.max("block")).first()[0]
    if n is None:
        return None
    return Model(table.join(blocks, "lang"), n + 1)


def _scored(shared):
    """The best language of a block for each text, its bits, and the sum of all its languages' chances against it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = model.code_lengths(*buffers(batch.column(batch.num_columns - 1)))
            best, least = bits.argmin(axis=1), bits.min(axis=1)
            mass = np.exp2(least[:, None] - bits).sum(axis=1)
            columns = [pa.array(model.langs[best].tolist(), pa.string()), pa.array(least), pa.array(mass)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "lang_pred", "bits", "mass"])

    return run


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``; the score is the posterior of equal priors.

    A text that is null or has no letter is ``und`` with score 0, as is every text without a model.
    Equal code lengths go to the first language by name.  Long texts are read slice by slice.  With several blocks of
    languages the texts are written once and read once for each block; a row's best blocks then meet in one sum.
    """
    spark = docs.sparkSession
    small_batches(spark)
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    base = docs.select(F.col(id_col).alias("id"), letter.alias("letter"), F.col(text_col).alias("text"))
    if model is None:
        return base.select(F.col("id").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if model.blocks > 1:
        base = written(base.select(F.monotonically_increasing_id().alias("row"), "*"), "texts")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    parts = []
    for k in range(model.blocks):
        part = base.mapInArrow(_scored(spark.sparkContext.broadcast(model.block(k))), f"{kinds}, lang_pred string, bits double, mass double")
        parts.append(written(part, "scores") if model.blocks > 1 else part)
    out = parts[0]
    if model.blocks > 1:
        for part in parts[1:]:
            out = out.unionByName(part)
        best = F.min(F.struct("bits", "lang_pred"))
        found = out.groupBy("row").agg(F.first("id").alias("id"), F.first("letter").alias("letter"), best.alias("b"), F.collect_list(F.struct("bits", "mass")).alias("all"))
        mass = F.aggregate("all", F.lit(0.0), lambda m, x: m + x["mass"] * F.pow(F.lit(2.0), F.col("b.bits") - x["bits"]))
        out = found.select("id", "letter", F.col("b.lang_pred").alias("lang_pred"), mass.alias("mass"))
    return out.select(F.col("id").alias("doc_id"), F.when(F.col("letter"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letter"), 1 / F.col("mass")).otherwise(0.0).alias("score"))
