"""Benchmark decontamination with an FM-index over each shard of training texts.

A test item's windows of ``width`` consecutive words (the whole item where it is shorter) are the
phrases.  Each task cuts its rows into shards of bounded size and builds an FM-index of each: the
suffix array's Burrows-Wheeler transform in a wavelet matrix, and a sample of suffix positions.
All phrases are searched backwards at once; their rows are walked back to sampled positions, and
the word spans found are merged per document.  Every document stays in its task: no shuffle.

The index's alphabet is the words of the phrases.  A word outside it, or a run of alphabet words
shorter than the shortest phrase, cannot lie in any occurrence and is folded into a separator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import free_name, small_batches, written
from .text import ALNUM, buffers, chunks, word_hashes, words

WIDTH = 10
#: Bytes of text in one shard's index, and of test items in one pass over the shards.
SHARD_BYTES, PASS_BYTES = 32 << 20, 4 << 20
SAMPLE = 16
_ROWS = 1 << 20


class FMIndex:
    """Counts and locates phrases in ``text``: symbols from 2 on, runs of them ended by 1, 0 at the end."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        suffixes = _suffix_array(text)
        before = text[suffixes - 1]
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=symbols)))
        # The walk back stops at a run's first word at the latest, so it never crosses a separator.
        kept = (suffixes % SAMPLE == 0) | (before <= 1)
        self.kept, self.sample_rank, self.samples = kept, np.append(0, np.cumsum(kept)), suffixes[kept]
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros, row = [], [], before
        for level in range(self.levels):
            bit = (row >> (self.levels - 1 - level)) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.start = np.zeros(symbols, np.int64)
        self.start = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def _descend(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            ones = self.ones[level][row]
            row = np.where((symbol >> (self.levels - 1 - level)) & 1, self.zeros[level] + ones, row - ones)
        return row

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``row`` in the transform."""
        return self._descend(symbol, row) - self.start[symbol]

    def back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one symbol earlier."""
        symbol = np.zeros(len(row), np.int64)
        for level in range(self.levels):
            ones = self.ones[level][row]
            bit = self.ones[level][row + 1] - ones
            row = np.where(bit, self.zeros[level] + ones, row - ones)
            symbol = symbol * 2 + bit
        return self.first[symbol] + row - self.start[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that start with each phrase."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.kept), np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((lengths > k) & (low < high))
            symbol = phrases[live, k]
            low[live] = self.first[symbol] + self.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """The text positions of suffix rows."""
        out, steps, at = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        while len(at):
            hit = self.kept[row]
            out[at[hit]] = self.samples[self.sample_rank[row[hit]]] + steps
            at, row = at[~hit], self.back(row[~hit])
            steps += 1
        return out


def _suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order; each separator is a symbol of its own, ordered by position."""
    n = len(text)
    key = np.where(text == 1, np.arange(n), n + text.astype(np.int64))
    key[text == 0] = -1
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    step = 1
    while rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


class Phrases:
    """The windows of some test items, as vocabulary ids, and the items of each window."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        raw, offsets = buffers(pa.array([t or "" for _, t in items], pa.string()))
        start, end, first = words(raw, offsets, ALNUM)
        hashes = word_hashes(raw, start, end)
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        self.names = [i for i, _ in items]
        windows: dict[tuple[int, ...], set[int]] = {}
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            own = (ids[a:b] + 2).tolist()
            for x in range(max(1, len(own) - width + 1) if own else 0):
                windows.setdefault(tuple(own[x : x + width]), set()).add(k)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.symbols = np.zeros((len(windows), width), np.int64)
        for k, w in enumerate(windows):
            self.symbols[k, : len(w)] = w
        self.items = [sorted(v) for v in windows.values()]
        self.shortest = int(self.lengths.min()) if len(windows) else 0
        self.slots = np.zeros(1 << 16, bool)
        self.slots[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 for words of no phrase."""
        out = np.zeros(len(hashes), np.int32)
        if len(self.vocabulary):
            near = np.flatnonzero(self.slots[(hashes >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[near]), len(self.vocabulary) - 1)
            out[near] = np.where(self.vocabulary[at] == hashes[near], at + 2, 0)
        return out

    def occurrences(self, ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word indexes, windows) of all occurrences in a shard whose rows begin at words ``first``."""
        if not len(self.lengths):
            return
        inside = ids > 0
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        begins = first[:-1][np.diff(first) > 0]
        opens[begins] = inside[begins]
        run = np.cumsum(opens) - 1
        place = np.flatnonzero(inside)
        sizes = np.bincount(run[place])
        if not len(place) or sizes.max() < self.shortest:
            return
        long = sizes >= self.shortest
        place = place[long[run[place]]]
        moved = np.cumsum(long)[run[place]] - 1 + np.arange(len(place))  # one separator after each run
        text = np.ones(len(place) + int(long.sum()) + 1, np.int64)
        text[moved], text[-1] = ids[place], 0
        word_of = np.zeros(len(text), np.int64)
        word_of[moved] = place
        index = FMIndex(text, len(self.vocabulary) + 2)
        low, high = index.search(self.symbols, self.lengths)
        counts = high - low
        total = np.append(0, np.cumsum(counts))
        for a in range(0, int(total[-1]), _ROWS):
            flat = np.arange(a, min(a + _ROWS, int(total[-1])))
            window = np.searchsorted(total, flat, "right") - 1
            yield word_of[index.locate(low[window] + flat - total[window])], window


def _found(phrases: Phrases, ids: np.ndarray, first: np.ndarray) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
    """Merged word spans and item ids of each row that has any."""
    edge = np.zeros(len(ids) + 1, np.int32)
    pairs = []
    for word, window in phrases.occurrences(ids, first):
        np.add.at(edge, word, 1)
        np.add.at(edge, word + phrases.lengths[window], -1)
        row = np.searchsorted(first, word, "right") - 1
        pairs.append(np.unique(row * len(phrases.lengths) + window))
    if not pairs:
        return {}, {}
    items: dict[int, set[str]] = {}
    for pair in np.unique(np.concatenate(pairs)).tolist():
        row, window = divmod(pair, len(phrases.lengths))
        items.setdefault(row, set()).update(phrases.names[k] for k in phrases.items[window])
    hit = np.cumsum(edge[:-1]) > 0
    spans = {}
    for row in items:
        own = np.diff(np.concatenate([[0], hit[first[row] : first[row + 1]].astype(np.int8), [0]]))
        spans[row] = list(zip(np.flatnonzero(own == 1).tolist(), np.flatnonzero(own == -1).tolist(), strict=True))
    return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
_KINDS = [T.LongType(), _SPANS, T.ArrayType(T.StringType())]
_ARROW = [pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.list_(pa.string())]


def _searched(shared, text: int, earlier: bool, cut: bool, added_names: list[str]):
    """Adds word counts, spans and items to the rows, or (cut) removes the spans from their texts."""

    def close(shard: list, phrases: Phrases) -> Iterator[pa.RecordBatch]:
        if not shard:
            return
        counts = [n for _, _, n in shard]
        lengths = np.concatenate(counts)
        first = np.append(0, np.cumsum(lengths))
        spans, items = _found(phrases, np.concatenate([i for _, i, _ in shard]), first)
        at = 0
        for batch, _, own in shard:
            n = batch.num_rows
            columns = batch.columns[: batch.num_columns - (3 if earlier else 0)]
            marks, names = [spans.get(at + k, []) for k in range(n)], [items.get(at + k, set()) for k in range(n)]
            if earlier:
                marks = [_merged(m + [(x["a"], x["b"]) for x in old]) for m, old in zip(marks, batch.columns[-2].to_pylist(), strict=True)]
                names = [m | set(old) for m, old in zip(names, batch.columns[-1].to_pylist(), strict=True)]
            if cut:
                columns[text] = _without(columns[text], marks)
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names[: len(columns)])
            else:
                added = [pa.array(own, pa.int64()), pa.array([[{"a": a, "b": b} for a, b in m] for m in marks], _ARROW[1]), pa.array([sorted(m) for m in names], _ARROW[2])]
                yield pa.RecordBatch.from_arrays([*columns, *added], [*batch.schema.names[: len(columns)], *added_names])
            at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, shard, held = Phrases(*shared.value), [], 0
        for batch in batches:
            raw, offsets = buffers(batch.column(text))
            ids, counts = [], []
            for a, b in chunks(offsets, 1 << 20):
                part, own = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                start, end, first = words(part, own, ALNUM)
                ids.append(phrases.ids(word_hashes(part, start, end)))
                counts.append(np.diff(first))
            if held and held + len(raw) > SHARD_BYTES:
                yield from close(shard, phrases)
                shard, held = [], 0
            if batch.num_rows:
                shard.append((batch, np.concatenate(ids), np.concatenate(counts)))
            held += len(raw)
        yield from close(shard, phrases)

    return run


def _without(column: pa.Array, marks: list[list[tuple[int, int]]]) -> pa.Array:
    """The texts without the bytes from each span's first word to its last."""
    if not any(marks):
        return column
    out = column.to_pylist()
    for k, spans in enumerate(marks):
        if spans:
            raw = np.frombuffer(out[k].encode(), np.uint8)
            start, end, _ = words(raw, np.array([0, len(raw)]), ALNUM)
            data, at, parts = raw.tobytes(), 0, []
            for a, b in spans:
                parts.append(data[at : start[a]])
                at = end[b - 1]
            out[k] = b"".join([*parts, data[at:]]).decode()
    return pa.array(out, column.type)


def _passes(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, width: int, cut: bool) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // PASS_BYTES))
    out, plain = docs, len(docs.columns)
    names = [free_name(docs, n) for n in ("__n_words", "__spans", "__items")]
    added = [T.StructField(n, kind) for n, kind in zip(names, _KINDS, strict=True)]
    text = docs.columns.index(text_col)
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        shared = spark.sparkContext.broadcast(([tuple(x) for x in part.collect()], width))  # PASS_BYTES in the mean
        last = k == blocks - 1
        schema = docs.schema if cut and last else T.StructType([*docs.schema.fields, *added])
        out = out.mapInArrow(_searched(shared, text, len(out.columns) > plain, cut and last, names), schema)
        if not last:
            out = written(out, "searched")
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans) for every row of ``docs``.

    Words are runs of digits, letters a-z (A-Z folded) and non-ASCII characters.  A document word is
    hit inside any occurrence of a window of an item; ``hit_spans`` has the merged spans as word
    indexes, the end exclusive.  Null and empty texts have no words and no hits; items without id,
    text or words are never found; repeated items count once by id.  The benchmark is searched in
    passes of at most about ``PASS_BYTES`` of its texts, so what is broadcast does not grow with it.
    """
    found = _passes(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, "text", item_col, item_text, width, False)
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select("doc_id", F.col("__n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"), (F.size("__items") > 0).alias("contaminated"), F.col("__spans").alias("hit_spans"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with every hit span cut out of its text, from the first hit word to the last."""
    return _passes(docs, benchmark, text_col, item_col, item_text, width, True)
