"""Token counts kept up to date by signed deltas.

Every batch of changes is a table of its own in the ledger folder, written once under the batch's
id: a commit of an id that is already there does nothing.  A change inserts, deletes or revises a
document; it becomes signed rows (+1 for a count that comes, -1 for one that goes).  A batch's rows
are summed once into its part of the rollup, by source, language and tokenizer version; the totals
add these parts and never go back to the rows.  A batch counts once its part of the rollup is whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import small_batches, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VERSION = "byte_bpe_50k"
#: Fixed value: the public pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ("source", "lang", "version")
_ROLLUP = "source string, lang string, version string, n_docs long, n_tokens long, n_chars long"
_COUNTED = ("doc_id", "source", "lang", "n_tokens", "n_chars")
#: The place of changes without one in the order of a batch.
_FIRST = -(1 << 63)
_encodings: dict[str, object] = {}


def _encoding(path: str):
    """The worker's tokenizer, read once."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _counter(path: str, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in batches:
            texts = batch.column(text)
            counts = pa.array([len(encoding.encode_ordinary(t.as_py() or "")) for t in texts], pa.int64())
            columns, names = list(batch.columns), list(batch.schema.names)
            columns[text], names[text] = counts, "n_tokens"
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


class Ledger:
    """Totals of token counts in a folder that all executors share.

    ``commit`` takes changes with columns op ('insert', 'delete' or 'revise'), doc_id, source, lang,
    text and, if a document can have several changes in a batch, seq: they apply in its order.  Of
    the same seq (a missing or null one comes first), inserts apply before revisions and these
    before deletes; of revisions with the same seq, that of the greatest text hash is left.

    A deleted or revised document leaves with all counts that the ledger holds for it, whatever
    their tokenizer version, and with those of earlier changes of its batch; of a document that
    isn't held, a delete changes nothing and a revision inserts.  Inserting a document again adds it
    again; without doc_id, revisions insert and deletes change nothing.  Null texts count 0 tokens;
    null sources and languages are groups of their own; changes without op are ignored.  Ids of any
    type are told apart by their text.  Texts may be of any length; Arrow batches are bounded in
    bytes.  One batch is committed at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, tokenizer: str = TOKENIZER, version: str = VERSION):
        self.spark, self.folder, self.tokenizer, self.version = spark, folder.rstrip("/"), tokenizer, version

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def committed(self) -> list[str]:
        """The ids of the batches whose part of the rollup is whole."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/rollup/batch=*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        return [f.getPath().getParent().getName().removeprefix("batch=") for f in found or []]

    def _read(self, part: str, columns: str) -> DataFrame | None:
        """A part of the ledger, of committed batches only; None before the first."""
        batches = self.committed()
        if not batches:
            return None
        return self.spark.read.schema(f"{columns}, batch string").parquet(f"{self.folder}/{part}").where(F.col("batch").isin(batches))

    def rows(self) -> DataFrame | None:
        """All signed rows of committed batches; None before the first.  Ids are text."""
        return self._read("batches", "doc_id string, source string, lang string, version string, sign long, n_tokens long, n_chars long")

    def rollup(self) -> DataFrame | None:
        """What each committed batch adds to the totals: one row for a group that it touches; None before the first."""
        return self._read("rollup", _ROLLUP)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was applied before.  The _SUCCESS file of its rollup makes it count."""
        if not batch or set(batch) & set("/=:%"):
            raise ValueError(f"a batch id can't be {batch!r}: it names a folder")
        path = f"{self.folder}/batches/batch={batch}"
        if self._exists(f"{self.folder}/rollup/batch={batch}/_SUCCESS"):
            return False
        small_batches(self.spark)
        seq = F.coalesce(F.col("seq").cast("long"), F.lit(_FIRST)) if "seq" in changes.columns else F.lit(_FIRST)
        rank = F.expr("case op when 'insert' then 0 when 'revise' then 1 when 'delete' then 2 end")
        text = F.when(F.col("op") != "delete", F.col("text"))
        changes = changes.select(F.col("doc_id").cast("string").alias("doc_id"), seq.alias("seq"), rank.alias("rank"), F.xxhash64("text").alias("hash"), "source", "lang", F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"), text.alias("text"))
        changes = changes.where("rank < 2 or rank = 2 and doc_id is not null")
        changes = written(changes.mapInArrow(_counter(self.tokenizer, 7), "doc_id string, seq long, rank int, hash long, source string, lang string, n_chars long, n_tokens long"), "changes")
        # The last change of a document that clears it, and the inserts after that.
        last = changes.where("rank > 0 and doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("seq", "rank", "hash", "source", "lang", "n_chars", "n_tokens")).alias("last"))
        added = changes.where("rank = 0 or doc_id is null").withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("hash", "source", "lang", "n_chars")).otherwise(F.lit(0)))
        cleared = last.select("doc_id", F.lit(0).cast("long").alias("spread"), F.col("last.seq").alias("cleared"))
        added = added.join(cleared, ["doc_id", "spread"], "left").where("cleared is null or seq > cleared")
        coming = added.select(*_COUNTED).unionByName(last.where("last.rank = 1").select("doc_id", *[F.col(f"last.{c}").alias(c) for c in _COUNTED[1:]]))
        signed = coming.select("doc_id", "source", "lang", F.lit(self.version).alias("version"), F.lit(1).cast("long").alias("sign"), "n_tokens", "n_chars")
        held = self.rows()
        if held is not None:
            held = held.where(F.col("batch") != batch).join(last.select("doc_id"), "doc_id", "left_semi")
            state = held.groupBy("doc_id", *KEYS).agg(*[F.sum(c).alias(c) for c in ("sign", "n_tokens", "n_chars")]).where("sign <> 0")
            signed = signed.unionByName(state.select("doc_id", *KEYS, *[(-F.col(c)).alias(c) for c in ("sign", "n_tokens", "n_chars")]))
        signed.write.mode("overwrite").parquet(path)
        stored = self.spark.read.schema(signed.schema).parquet(path)
        delta = stored.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_chars").alias("n_chars"))
        delta.write.mode("overwrite").parquet(f"{self.folder}/rollup/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens, n_chars) of what the ledger holds, without empty groups; none before the first commit."""
        parts = self.rollup()
        if parts is None:
            return self.spark.createDataFrame([], _ROLLUP)
        sums = parts.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_chars")])
        return sums.where("n_docs <> 0 or n_tokens <> 0")
