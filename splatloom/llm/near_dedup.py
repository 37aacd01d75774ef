"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find.

A text's set holds the distinct hashes of its word shingles.  SuperMinHash gives each element a
random permutation of the signature's slots and the ranks ``j + r_j`` along it; a slot keeps the
least rank that reaches it.  Ranks of one element never collide, which lowers the variance against
plain MinHash, and a document is finished at the first level below which all of its slots are
filled.  The levels are evaluated for all elements of a batch at once.

Documents of equal sets form a class, and one of each class goes on.  Classes that share a band of
the signature meet in a bucket.  Within it, links are confirmed on the full sets and reduced to a
spanning forest, so a bucket of ``k`` documents emits fewer than ``k`` edges, never all pairs.

The first bands go first.  A large bucket of theirs is dealt into groups of bounded size, each with
the bucket's centre, one of its members: this links a group of near copies in work that grows with
its size.  Of the buckets of all bands, only those are then looked at whose members are not yet in
one component; large ones go in pairs of blocks made up by component, and two blocks of the same
component are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import SALTS, connected_components
from .session import free_name, small_batches, written
from .text import NOT_SPACE, buffers, chunks, mix, ngram_hashes, seeded, word_hashes, words

#: 36 bands of 6 rows: a pair at a similarity of exactly 0.8 shares no band with probability 2e-5.
BANDS, ROWS = 36, 6
#: Bands that are looked at first.
FIRST_BANDS = 4
#: Documents, and elements of sets, in one group or block of a large bucket.
BLOCK_DOCS, BLOCK_ELEMENTS = 256, 500_000
#: Bits of the filter that spares documents without candidates from being hashed again.
FILTER_BITS = 1 << 23
_CHUNK = 1 << 20


def text_sets(raw: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, offsets): the sorted distinct shingle hashes of each text."""
    start, end, first = words(raw, offsets, NOT_SPACE)
    hashes = word_hashes(raw, start, end)
    grams = ngram_hashes(hashes, shingle)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= shingle:
            sets.append(np.unique(grams[a : b - shingle + 1]))
        elif b > a:
            sets.append(ngram_hashes(hashes[a:b], b - a))
        else:
            sets.append(hashes[:0])
    return (np.concatenate(sets) if sets else hashes[:0]), np.cumsum([0, *map(len, sets)])


def superminhash(items: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """Signatures uint32 [documents, m]; the high 8 bits are the level, the low 24 the random rank."""
    n = len(offsets) - 1
    out = np.full((n, m), 0xFFFFFFFF, np.uint32)
    flat = out.reshape(-1)
    doc = np.repeat(np.arange(n), np.diff(offsets))

    def drawn(level: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = seeded(values, level)
        pick = (r >> np.uint64(32)) % np.uint64(m - level)
        return level + pick.astype(np.int64), (np.uint32(level) << np.uint32(24)) | (r & np.uint64(0xFFFFFF)).astype(np.uint32)

    slot, rank = drawn(0, items)
    np.minimum.at(flat, doc * m + slot, rank)
    open_ = np.zeros(n, bool)
    filled = np.flatnonzero(np.diff(offsets))
    open_[filled] = out[filled].max(axis=1) >= 1 << 24
    keep = open_[doc]
    items, doc, slot = items[keep], doc[keep], slot[keep]
    perm = np.empty((len(items), m), np.uint8)
    perm[:] = np.arange(m, dtype=np.uint8)
    row = np.arange(len(items))
    perm[row, slot] = 0
    perm[:, 0] = slot
    for level in range(1, m):
        if not len(items):
            break
        pick, rank = drawn(level, items)
        at = perm[row, pick]
        perm[row, pick] = perm[:, level]
        perm[:, level] = at
        np.minimum.at(flat, doc * m + at, rank)
        live = np.flatnonzero(open_)
        open_[live] = out[live].max(axis=1) >= (level + 1) << 24
        keep = open_[doc]
        if keep.sum() < 0.7 * len(keep) or not keep.any():
            items, doc, perm = items[keep], doc[keep], perm[keep]
            row = np.arange(len(items))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _digests(items: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two 64-bit sums of each set's hashed elements; 0 for an empty set."""
    out, full = np.zeros((2, len(at) - 1), np.uint64), np.flatnonzero(np.diff(at))
    for k in range(2 if len(full) else 0):
        out[k, full] = np.add.reduceat(seeded(items, 1000 + k), at[:-1][full])
    return out


def _described(shingle: int, bands: int, rows: int):
    """(id, row_hash, n, d1, d2, bands): the set's size, its digests and the hashes of the signature's bands."""
    weights = seeded(np.arange(rows, dtype=np.uint64), 99) | np.uint64(1)
    salt = seeded(np.arange(bands, dtype=np.uint64), 98)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(2))
            for a, b in chunks(offsets, _CHUNK):
                part, own = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                items, at = text_sets(part, own, shingle)
                digest = _digests(items, at)
                signature = superminhash(items, at, bands * rows).reshape(b - a, bands, rows)
                keys = mix((signature.astype(np.uint64) * weights).sum(axis=2) + salt)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bands, bands, dtype=np.int32)), pa.array(_signed(keys.reshape(-1))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(at).astype(np.int64)), pa.array(_signed(digest[0])), pa.array(_signed(digest[1])), lists],
                    ["id", "row_hash", "n", "d1", "d2", "bands"],
                )

    return run


def _sets_of(shingle: int, bits: np.ndarray):
    """(d1, d2, elements) of the rows that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((bits[bit >> 3] >> (bit & 7)) & 1 == 1))
            if not batch.num_rows:
                continue
            raw, offsets = buffers(batch.column(1))
            for a, b in chunks(offsets, _CHUNK):
                items, at = text_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                digest = _digests(items, at)
                packed = [items[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(_signed(digest[0])), pa.array(_signed(digest[1])), pa.array(packed, pa.binary())], ["d1", "d2", "elements"])

    return run


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def linked_forest(sets: list[np.ndarray], share: tuple[int, int]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the sets whose intersection is at least share[0]/share[1] of their union.

    Each comparison counts the shared elements of one set with every other set.  Sets of the largest
    tree are left out for as long as it is the largest; passes go on until all sets left out lie in
    one tree.  Every link between two trees then has an end that was compared.
    """
    up, down = share
    if len(sets) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if down * common >= up * (len(sets[0]) + len(sets[1]) - common) else []
    n, sizes = len(sets), np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(ids, kind="stable")
    holders, at = owner[order], np.append(np.searchsorted(ids[order], np.arange(ids.max() + 1)), len(ids))
    own = np.append(0, np.cumsum(sizes))
    parent, weight, edges, done = list(range(n)), [1] * n, [], np.zeros(n, bool)
    left, biggest = np.argsort(-sizes, kind="stable").tolist(), None
    while left:
        for x in left:
            if biggest is not None and _find(parent, x) == _find(parent, biggest):
                continue
            done[x] = True
            mine = ids[own[x] : own[x + 1]]
            lengths = at[mine + 1] - at[mine]
            places = np.repeat(at[mine] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
            common = np.bincount(holders[places], minlength=n)
            for y in np.flatnonzero(down * common >= up * (sizes + sizes[x] - common)).tolist():
                a, b = _find(parent, x), _find(parent, y)
                if a != b:
                    parent[b] = a
                    weight[a] += weight[b]
                    edges.append((x, y))
            if biggest is None or weight[_find(parent, x)] > weight[_find(parent, biggest)]:
                biggest = x
        left = [x for x in left if not done[x] and _find(parent, x) != _find(parent, biggest)]
    return edges


def _verified(share: tuple[int, int]):
    """Links of each run of rows with the same (key, i, j), from rows sorted by these."""

    def edges(group: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
        if len(group) < 2:
            return []
        sets = [np.frombuffer(e, np.uint64) for _, e in group]
        return [(group[x][0], group[y][0]) for x, y in linked_forest(sets, share)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = [], None
        for batch in batches:
            found = []
            for key, i, j, node, elements in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != last:
                    found += edges(group)
                    group, last = [], (key, i, j)
                group.append((node, elements))
            if found:
                yield _edge_batch(found)
        if found := edges(group):
            yield _edge_batch(found)

    return run


def _edge_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _bit(row_hash: Column) -> Column:
    return F.pmod(row_hash, F.lit(FILTER_BITS))


def _filter_bits(rows: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with each ``row_hash`` set; a full one only lets more rows through."""
    hashed = rows.select(_bit(F.col("row_hash")).alias("bit"))
    table = hashed.groupBy(F.expr("bit div 8").alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(bit % 8 as int)))").alias("v")).toArrow()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    bits[table.column(0).to_numpy()] = table.column(1).to_numpy().astype(np.uint8)
    return bits


def _linked(dealt: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Edges (a, b) of each group (key, i, j) of the nodes in ``dealt``."""
    together = dealt.join(sets, "node").select("key", "i", "j", "node", "elements")
    together = together.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return together.mapInArrow(_verified(share), "a long, b long")


def _members(in_bands: DataFrame, name: str) -> DataFrame:
    """``in_bands`` with centre and groups, for the buckets with nodes of different components; of those with the same members, one."""
    open_ = in_bands.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    members = written(in_bands.join(open_, "key"), name)
    buckets = members.groupBy("key").agg(F.count("*").alias("k"), F.min("node").alias("centre"), F.bit_xor(F.xxhash64("node")).alias("who"), F.sum("n").alias("elements"))
    buckets = buckets.groupBy("k", "centre", "who").agg(F.min("key").alias("key"), F.first("elements").alias("elements"))
    groups = F.greatest(F.ceil(F.col("k") / BLOCK_DOCS), F.ceil(F.col("elements") / BLOCK_ELEMENTS)).cast("long")
    return members.join(buckets.select("key", "centre", groups.alias("groups")), "key")


def _in_groups(members: DataFrame) -> DataFrame:
    """(key, i, j, node): each bucket in groups, its centre in each of them."""
    zero, own = F.lit(0).cast("long"), F.pmod(F.xxhash64("node", F.lit(5)), F.col("groups"))
    dealt = lambda i: [F.col("key"), i.alias("i"), zero.alias("j"), F.col("node")]
    return members.where("node <> centre").select(*dealt(own)).unionByName(members.where("node = centre").select(*dealt(F.explode(F.sequence(zero, F.col("groups") - 1)))))


def _in_block_pairs(members: DataFrame) -> DataFrame:
    """(key, i, j, node): pairs of blocks that hold all pairs of a bucket's nodes of different components.

    A component of at least half a block has blocks of its own; smaller ones are dealt into mixed blocks.
    """
    size = lambda docs, elements: F.greatest(F.ceil(F.col(docs) / BLOCK_DOCS), F.ceil(F.col(elements) / BLOCK_ELEMENTS), F.lit(1)).cast("int")
    parts = members.groupBy("key", "component").agg(F.count("*").alias("docs"), F.sum("n").alias("elements"))
    parts = parts.withColumn("own", (F.col("docs") >= BLOCK_DOCS / 2) | (F.col("elements") >= BLOCK_ELEMENTS / 2))
    mixed = parts.where("not own").groupBy("key").agg(F.sum("docs").alias("m_docs"), F.sum("elements").alias("m_elements"))
    parts = parts.join(mixed, "key", "left")
    parts = parts.select("key", "component", F.when(F.col("own"), F.col("component")).alias("whole"), F.when(F.col("own"), size("docs", "elements")).otherwise(size("m_docs", "m_elements")).alias("of"))
    spread = F.pmod(F.when(F.col("whole").isNull(), F.xxhash64("component")).otherwise(F.xxhash64("node")), F.col("of"))
    block = F.xxhash64("whole", spread)
    dealt = written(members.select("key", "node", "component").join(parts, ["key", "component"]).select("key", "node", "whole", block.alias("block")), "blocks")
    blocks = dealt.select("key", "whole", "block").distinct()
    other = blocks.select("key", F.col("whole").alias("whole2"), F.col("block").alias("block2"))
    pairs = blocks.join(other, "key").where("block <= block2 and (whole is null or whole2 is null or whole <> whole2)")
    ends = pairs.select("key", F.col("block").alias("i"), F.col("block2").alias("j"), F.explode(F.array_distinct(F.array("block", "block2"))).alias("block")).distinct()
    return dealt.select("key", "block", "node").join(ends, ["key", "block"]).select("key", "i", "j", "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, share: tuple[int, int] = (80, 100), bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``; ids are of any type with an order.

    Two texts are linked where share[1] * intersection >= share[0] * union of their distinct
    ``shingle``-word sets, with A-Z in lower case; a shorter text's set is its whole word sequence.
    A null, empty or white-space text has an empty set and no links.  Rows are compared by their
    texts, so rows of one id with different texts have components of their own, and rows of the same
    id and text stay together; a row without id is linked with nothing, has no component and is kept.
    Every text is read whole, however long; other columns of ``docs`` are not looked at.
    """
    if bands * rows > 256:
        raise ValueError("a signature has at most 256 slots")
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row_hash"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    signs = written(base.mapInArrow(_described(shingle, bands, rows), f"id {kind}, row_hash long, n long, d1 long, d2 long, bands array<long>"), "signatures")
    linkable = signs.where("n > 0 and id is not null")
    # One row of each class stands for it; the table is written, so the numbers of the classes, the nodes, stay.
    classes = linkable.groupBy("d1", "d2").agg(F.min("id").alias("least"), F.min("row_hash").alias("row_hash"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def sets_of(members: DataFrame) -> DataFrame:
        bits = _filter_bits(members.select("node").distinct().join(classes, "node"))
        rows_let = base.where("id is not null").select(_bit(F.col("row_hash")).alias("bit"), "text")
        found = rows_let.mapInArrow(_sets_of(shingle, bits), "d1 long, d2 long, elements binary")
        return found.join(classes.select("d1", "d2", "node"), ["d1", "d2"]).dropDuplicates(["node"]).select("node", "elements")

    def in_bands(classes: DataFrame, first: int) -> DataFrame:
        return classes.select("node", "n", "component", F.explode(F.slice("bands", 1, first)).alias("key"))

    members = _members(in_bands(classes.withColumn("component", F.col("node")), min(FIRST_BANDS, bands)), "members")
    edges = written(_linked(_in_groups(members), sets_of(members), share), "edges")

    groups = connected_components(edges)
    members = written(_members(in_bands(classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), bands), "members"), "open")
    small = members.where("groups = 1").select("key", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "node")
    edges = edges.unionByName(_linked(small.unionByName(_in_block_pairs(members.where("groups > 1"))), sets_of(members), share))

    # A component takes the least id of its classes.  A large one is dealt over several tasks on its way back to them.
    groups = written(connected_components(edges), "groups")
    named = groups.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = groups.withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int")).join(named, ["component", "salt"]).select("node", "component_id")
    labelled = classes.select("d1", "d2", "node", "least").join(named, "node", "left").select("d1", "d2", F.coalesce("component_id", "least").alias("component_id"))
    out = signs.select("id", "n", "d1", "d2").join(labelled, ["d1", "d2"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with their columns; rows of one id are judged one by one."""
    row = free_name(docs, "__row")
    texts = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text")).alias(row), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    found = near_duplicates(texts.where(F.col("id").isNotNull()), row, "text", **options)
    dropped = found.where("not kept").select(F.col("doc_id").alias(row)).distinct()
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    return docs.join(dropped, key == F.col(row), "left_anti")
