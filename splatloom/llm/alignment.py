"""Alignment of two tokenizers over the same bytes, by interval coalescing.

The tokens of both tokenizers are byte intervals.  A lexsort by start and a running maximum of the ends cut them
into groups: a group breaks where a start reaches the maximum.  Within groups, tokens that overlap are links.
A document's distinct links go, packed, to a written table, so texts are tokenised once.  Tasks sum the number
of documents of each id pair before these are shuffled.  The counts come back to the documents in two ways with
the same result: those of the most frequent pairs, of which there are at most HEAVY, go to every task; those of
all others come by a join on the pair.  A pair of that join has few rows, since frequent pairs are not in it.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import small_batches, written
from .text import chunks
from .token_counts import PATTERN

TOKENIZER_A, TOKENIZER_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Id pairs whose counts are sent to every task: 17 bytes each.
HEAVY = 1 << 18
#: Bytes of text that are aligned at once (or one text), and distinct pairs that a task holds before it passes them on.
PART, HELD = 2 << 20, 1 << 21
_SPACE = "▁"
_loaded: dict[str, tuple[Callable[[list[str]], list[list[int]]], list[bytes]]] = {}


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable ones for themselves, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_level(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """(encoder of texts, bytes of each id) of a byte-level BPE in a tokenizer's JSON file.

    Where merges stand in the order of their ids, they are ranks, and tiktoken applies them faster; the ids are the same.
    """
    if path not in _loaded:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        byte_of, vocab = _byte_of(), model["vocab"]
        table = [b""] * (1 + max(vocab.values()))
        for entry, at in vocab.items():
            table[at] = bytes(byte_of[c] for c in entry) if set(entry) <= byte_of.keys() else entry.encode()
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if merged == list(range(256, 256 + len(merged))) and len(vocab) == 256 + len(merged):
            import tiktoken

            ranks = {entry: at for at, entry in enumerate(table)}
            encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            _loaded[path] = (lambda texts: [encode(t) for t in texts]), table
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            _loaded[path] = (lambda texts: [whole.encode(t, add_special_tokens=False).ids for t in texts]), table
    return _loaded[path]


def pieces(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """(encoder of texts, bytes of each id) of a sentencepiece model; the encoder puts a space before each text."""
    if path not in _loaded:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = model.id_to_piece(list(range(model.get_piece_size())))
        table = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(names)]
        _loaded[path] = (lambda texts: model.encode(texts, num_threads=1)), table
    return _loaded[path]


def coalesced(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): intervals by start and side, and the number of the group of each in that order."""
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    broken = start[order][1:] >= reach[:-1]
    return order, np.concatenate([np.zeros(min(1, len(order)), np.int64), np.cumsum(broken)])


def overlapping(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): all pairs of intervals that overlap; the intervals of either side follow one another."""
    first, last = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    n = last - first
    a = np.repeat(np.arange(len(start_a)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n - first, n)


def packed(numbers: np.ndarray) -> bytes:
    """Non-negative numbers byte plane by byte plane, without the planes that are all zero."""
    planes = np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return struct.pack("<BI", width, len(numbers)) + planes[:width].tobytes()


def unpacked(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """(numbers, place behind them) of what ``packed`` gave."""
    width, n = struct.unpack_from("<BI", data, at)
    planes = np.zeros((8, n), np.uint8)
    planes[:width] = np.frombuffer(data, np.uint8, width * n, at + 5).reshape(width, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel(), at + 5 + width * n


def aligned(ids_a: list[list[int]], ids_b: list[list[int]], size_a: np.ndarray, size_b: np.ndarray) -> list[tuple[int, str, np.ndarray, np.ndarray]]:
    """Of each document, whose two token lists cover the same bytes: (groups, listing of the groups, a ids, b ids of all links)."""
    n_a, n_b = np.array([len(x) for x in ids_a]), np.array([len(x) for x in ids_b])
    a, b = (np.array([i for x in ids for i in x], np.int64) for ids in (ids_a, ids_b))
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    start_a, start_b = end_a - size_a[a], end_b - size_b[b]
    side = np.repeat([0, 1], [len(a), len(b)])
    order, group = coalesced(np.append(start_a, start_b), np.append(end_a, end_b), side)
    # Documents follow one another in the order of starts; within a group, A's tokens come before B's.
    part = 2 * group + side[order]
    listed = np.argsort(part, kind="stable")
    ids, part = np.append(a, b)[order][listed], part[listed]
    after = np.append(part[1:], -1)
    mark = np.where(after == part, 0, np.where(part % 2 == 0, 1, 2))
    link_a, link_b = overlapping(start_a, end_a, start_b, end_b)
    tokens, links = np.append(0, np.cumsum(n_a + n_b)), np.searchsorted(link_a, np.append(0, np.cumsum(n_a)))
    out = []
    for k in range(len(ids_a)):
        own = slice(tokens[k], tokens[k + 1])
        text = "".join(map("".join, zip(map(str, ids[own].tolist()), map(",|;".__getitem__, mark[own].tolist()), strict=True)))[:-1]
        n = int(part[own][-1] // 2 - part[own][0] // 2) + 1
        out.append((n, text, a[link_a[links[k] : links[k + 1]]], b[link_b[links[k] : links[k + 1]]]))
    return out


_ALIGNED = "row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def _aligner(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encode_a, table_a), (encode_b, table_b) = byte_level(path_a), pieces(path_b)
        size_a, size_b = (np.array([len(x) for x in t], np.int64) for t in (table_a, table_b))
        none = (0, 0, 0, 0, "", b"")
        for batch in batches:
            texts = batch.column(2).to_pylist()
            out = [none] * len(texts)
            for low, high in chunks(np.cumsum([0] + [len(t or "") for t in texts]), PART):
                rows = [i for i in range(low, high) if texts[i]]
                found_a, found_b = encode_a([" " + texts[i] for i in rows]), encode_b([texts[i] for i in rows])
                kept = []
                for i, x, y in zip(rows, found_a, found_b, strict=True):
                    raw = (" " + texts[i]).encode()
                    if b"".join(map(table_a.__getitem__, x)) == raw == b"".join(map(table_b.__getitem__, y)):
                        kept.append((i, x, y))
                if not kept:
                    continue
                where, ids_a, ids_b = zip(*kept, strict=True)
                for i, x, y, (n, listing, a, b) in zip(where, ids_a, ids_b, aligned(ids_a, ids_b, size_a, size_b), strict=True):
                    pairs, times = np.unique(a * len(table_b) + b, return_counts=True)
                    links = packed(np.diff(pairs, prepend=0)) + packed(times)
                    out[i] = (len(x), len(y), n, len(a), hashlib.sha256(listing.encode()).hexdigest(), links)
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string(), pa.binary()], strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    return run


def _links(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, how often each is linked) of a document."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    steps, at = unpacked(data)
    return np.cumsum(steps), unpacked(data, at)[0]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, documents) of a task's documents; a pair can come more than once."""
    pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh: list[np.ndarray] = []
    waiting = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, n = np.unique(np.concatenate([np.zeros(0, np.int64), *fresh]), return_counts=True)
        both = np.concatenate([pairs, keys])
        order = np.argsort(both, kind="stable")
        first = np.flatnonzero(np.diff(both[order], prepend=-1))
        return both[order][first], np.add.reduceat(np.concatenate([counts, n])[order], first) if len(first) else counts

    def told() -> Iterator[pa.RecordBatch]:
        for at in range(0, len(pairs), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + (1 << 16)]), pa.array(counts[at : at + (1 << 16)])], ["pair", "n"])

    for batch in batches:
        for data in batch.column(0):
            fresh.append(_links(data.as_py())[0])
            waiting += len(fresh[-1])
            if waiting > HELD:
                pairs, counts = merged()
                fresh, waiting = [], 0
                if len(pairs) > HELD:
                    yield from told()
                    pairs, counts = pairs[:0], counts[:0]
    pairs, counts = merged()
    yield from told()


def _weigher(keys: np.ndarray, counts: np.ndarray, best: np.ndarray, rest: bool):
    """Of each document: the sums over its links of frequent pairs; or, with ``rest``, a row for each other pair."""

    def split(data: bytes):
        pairs, times = _links(data)
        at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
        known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
        return pairs, times, at, known

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(batch.num_columns - 1):
                _, times, at, known = split(data.as_py())
                out.append((int((times * best[at])[known].sum()), int((times * counts[at])[known].sum())) if len(keys) else (0, 0))
            columns = [pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data in zip(batch.column(0), batch.column(1), strict=True):
                pairs, times, _, known = split(data.as_py())
                own = pairs[~known]
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), row.as_py())), pa.array(own), pa.array(times[~known])], ["row", "pair", "times"])

    return others if rest else sums


def _frequent(counts: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(least count, pairs, counts, whether best) of the pairs whose count is at least a power of two, HEAVY at most."""
    steps = counts.groupBy(F.floor(F.log2(F.col("n").cast("double"))).alias("step")).count().collect()
    least, held = 63, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        held += r["count"]
        if held > HEAVY:
            break
        least = r["step"]
    rows = counts.where(F.col("n") >= F.lit(1 << least)).select("pair", "n", "best").toArrow().sort_by("pair") if least < 63 else None
    if rows is None:
        return 1 << 62, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return 1 << least, *(rows.column(c).to_numpy().astype(np.int64) for c in ("pair", "n", "best"))


def pair_counts(links: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): how many documents hold a pair linked, and whether no other pair of its A id has more."""
    counts = written(links.select("links").mapInArrow(_counter, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a = F.floor(F.col("pair") / F.lit(size_b))
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return written(counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str = TOKENIZER_A, path_b: str = TOKENIZER_B) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    A encodes a space and the text, B the text, before which it puts a space itself.  Null and empty texts, and those
    of which either tokenizer does not give back all bytes, have no tokens: zeros, and an empty ``groups_sha256``.
    Strings of special tokens in a text are text.  A's tokens that are linked with equally many documents are all
    best.  Every row is a document of its own, repeated rows and ids and rows without id too.  A text is encoded
    as a whole, however long; its links are as many as its tokens at most.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = written(rows.mapInArrow(_aligner(path_a, path_b), _ALIGNED.replace("row long,", f"row long, doc_id {id_type},")), "alignments")
    counts = pair_counts(found, len(pieces(path_b)[1]))
    least, keys, n, best = _frequent(counts)
    own = found.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[:-1]) + ", n_best long, count_sum long"
    base = own.mapInArrow(_weigher(keys, n, best, False), schema)
    rest = found.select("row", "links").mapInArrow(_weigher(keys, n, best, True), "row long, pair long, times long")
    rest = rest.join(counts.where(F.col("n") < F.lit(least)), "pair")
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    add = lambda c, more: (F.col(c) + F.coalesce(F.col(more), F.lit(0))).alias(c)
    return base.join(rest, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", add("n_best", "more_best"), add("count_sum", "more_sum"), "groups_sha256")
