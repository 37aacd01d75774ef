"""Splat files as Spark data sources: binary PLY (read, write) and 32-byte .splat records (write, read).

``spark.dataSource.register(PlySource)`` makes ``format("splat_ply")`` known.  Reading splits a file
into ranges of rows, so one large file is read by many tasks; writing makes one whole file per task.
The option ``path`` is a file or a glob that driver and executors share.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, ShortType, StructField, StructType

#: The scalar types of a PLY header and what they are here.
PLY_TYPES = {
    "char": "<i1", "int8": "<i1", "uchar": "<u1", "uint8": "<u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4",
    "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8",
}
_SPARK = {"i1": ShortType(), "u1": ShortType(), "i2": ShortType(), "u2": IntegerType(), "i4": IntegerType(), "u4": LongType(), "f4": FloatType(), "f8": DoubleType()}
_NUMPY = {"float": "<f4", "double": "<f8", "integer": "<i4", "long": "<i4", "short": "<i2"}
_NAMES = {v: k for k, v in reversed(PLY_TYPES.items())}
ROWS_PER_PART = 500_000


def ply_header(path: str) -> tuple[np.dtype, int, int]:
    """(record type, number of vertices, first byte of the data) of a little-endian binary file."""
    fields, count, inside = [], 0, False
    with open(path, "rb") as f:
        if f.readline().strip() != b"ply":
            raise ValueError(f"{path} is no PLY file")
        while (line := f.readline()) and (words := line.split()) != [b"end_header"]:
            if words[0] == b"format" and words[1] != b"binary_little_endian":
                raise ValueError(f"{path}: only binary little-endian files are read")
            elif words[0] == b"element":
                inside = words[1] == b"vertex"
                count = int(words[2]) if inside else count
            elif words[0] == b"property" and inside:
                fields.append((words[2].decode(), PLY_TYPES[words[1].decode()]))
        return np.dtype(fields), count, f.tell()


class _Range(InputPartition):
    def __init__(self, path: str, first: int, rows: int):
        super().__init__((path, first, rows))


class _PlyReader(DataSourceReader):
    def __init__(self, schema: StructType, paths: list[str]):
        self.names, self.paths = [f.name for f in schema.fields], paths

    def partitions(self):
        return [_Range(p, a, min(ROWS_PER_PART, n - a)) for p in self.paths for n in [ply_header(p)[1]] for a in range(0, n, ROWS_PER_PART)] or [_Range("", 0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        path, first, rows = partition.value
        if not rows:
            return
        kind, _, start = ply_header(path)
        data = np.memmap(path, kind, "r", start + first * kind.itemsize, (rows,))
        for a in range(0, rows, 50_000):
            part = data[a : a + 50_000]
            columns = [np.ascontiguousarray(part[n]) for n in self.names]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype({"i1": "i2", "u1": "i2", "u2": "i4", "u4": "i8"}.get(c.dtype.str[1:], c.dtype))) for c in columns], self.names)


class _PlyWriter(DataSourceArrowWriter):
    """Each task writes its rows to one file under a temporary name; the commit renames the files."""

    def __init__(self, schema: StructType, path: str, overwrite: bool):
        self.fields = [(f.name, _NUMPY[f.dataType.typeName()]) for f in schema.fields]
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        name, rows, kind = f"part-{uuid.uuid4().hex}", 0, np.dtype(self.fields)
        body = f"{self.path}/.{name}.body"
        with open(body, "wb") as f:
            for batch in iterator:
                out = np.zeros(batch.num_rows, kind)
                for k, (n, _) in enumerate(self.fields):
                    out[n] = batch.column(k).to_numpy(zero_copy_only=False)
                f.write(out.tobytes())
                rows += batch.num_rows
        with open(f"{self.path}/.{name}", "wb") as f, open(body, "rb") as g:
            header = ["ply", "format binary_little_endian 1.0", f"element vertex {rows}", *(f"property {_NAMES[t]} {n}" for n, t in self.fields), "end_header", ""]
            f.write("\n".join(header).encode())
            while piece := g.read(1 << 22):
                f.write(piece)
        os.remove(body)
        message = WriterCommitMessage()
        message.file = f"{self.path}/.{name}"
        return message

    def commit(self, messages) -> None:
        if self.overwrite:
            for old in glob.glob(f"{self.path}/*.ply"):
                os.remove(old)
        for m in messages:
            if m is not None:
                os.rename(m.file, f"{self.path}/{os.path.basename(m.file)[1:]}.ply")

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.file):
                os.remove(m.file)


class PlySource(DataSource):
    """``format("splat_ply")``: the vertex records of binary PLY files, columns by the header."""

    @classmethod
    def name(cls) -> str:
        return "splat_ply"

    def _paths(self) -> list[str]:
        path = self.options["path"].removeprefix("file://")
        return sorted(glob.glob(f"{path}/*.ply") if os.path.isdir(path) else glob.glob(path))

    def schema(self) -> StructType:
        kind = ply_header(self._paths()[0])[0]
        return StructType([StructField(n, _SPARK[kind[n].str[1:]]) for n in kind.names])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PlyReader(schema, self._paths())

    def writer(self, schema: StructType, overwrite: bool):
        return _PlyWriter(schema, self.options["path"].removeprefix("file://"), overwrite)


#: The record of a .splat file.
SPLAT = np.dtype([("centre", "<f4", 3), ("scale", "<f4", 3), ("color", "u1", 4), ("rotation", "u1", 4)])


def splat_bytes(rows: DataFrame) -> DataFrame:
    """(data): the .splat records of scene rows (mx.., sx.., c0.., opacity, qw..), a binary for each Arrow batch.

    Colours and opacity become bytes, unit quaternions q * 128 + 128, each rounded and clamped.
    """
    names = ["mx", "my", "mz", "sx", "sy", "sz", "c0", "c1", "c2", "opacity", "qw", "qx", "qy", "qz"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) if batch.num_rows else np.zeros((0, 14))
            out = np.zeros(len(v), SPLAT)
            out["centre"], out["scale"] = v[:, :3], v[:, 3:6]
            out["color"] = np.clip(np.floor(v[:, 6:10] * 255 + 0.5), 0, 255)
            turn = v[:, 10:] / np.maximum(np.linalg.norm(v[:, 10:], axis=1, keepdims=True), 1e-12)
            out["rotation"] = np.clip(np.floor(turn * 128 + 128.5), 0, 255)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], ["data"])

    return rows.select(*[c for c in names]).mapInArrow(run, "data binary")


def splat_rows(records: DataFrame) -> DataFrame:
    """Scene rows of a column ``data`` of .splat records; the inverse of ``splat_bytes`` up to its rounding."""
    names = ["mx", "my", "mz", "sx", "sy", "sz", "c0", "c1", "c2", "opacity", "qw", "qx", "qy", "qz"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                r = np.frombuffer(data, SPLAT)
                v = np.concatenate([r["centre"], r["scale"], r["color"] / 255.0, (r["rotation"] - 128.0) / 128.0], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(v[:, k].astype(np.float64)) for k in range(14)], names)

    return records.select("data").mapInArrow(run, ", ".join(f"{n} double" for n in names))
