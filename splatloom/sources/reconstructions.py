"""Reconstructions and scenes from files: COLMAP's binary tables, canonical splat records, NPZ archives.

Files are read by Spark's own ``binaryFile`` source, so any path that Spark can open will do.  A file is one
row and one task; its records leave in Arrow batches of bounded size.  ``binaryFile`` holds a file whole, up to 2 GB.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splatloom.functions import harmonics

#: Fixed values of the file format: a camera model's number, name, number of focal lengths and of distortion terms.
CAMERA_MODELS = {
    0: ("SIMPLE_PINHOLE", 1, 0),
    1: ("PINHOLE", 2, 0),
    2: ("SIMPLE_RADIAL", 1, 1),
    3: ("RADIAL", 1, 2),
    4: ("OPENCV", 2, 4),
    5: ("OPENCV_FISHEYE", 2, 4),
}
CAMERAS = "camera_id int, model string, width long, height long, fx double, fy double, cx double, cy double, distortion array<double>"
IMAGES = "image_id int, name string, camera_id int, qw double, qx double, qy double, qz double, t0 double, t1 double, t2 double, points array<struct<x:double,y:double,point_id:long>>"
POINTS = "point_id long, x double, y double, z double, red short, green short, blue short, error double, track array<struct<image_id:int,point_index:int>>"
_BATCH = 2_000


class _Bytes:
    """A cursor over a file's bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        out = struct.unpack_from(f"<{form}", self.data, self.at)
        self.at += struct.calcsize(f"<{form}")
        return out

    def array(self, kind: np.dtype, count: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, count, self.at)
        self.at += out.nbytes
        return out

    def text(self) -> str:
        end = self.data.index(b"\0", self.at)
        out, self.at = self.data[self.at : end].decode("utf-8", "replace"), end + 1
        return out


def _camera(b: _Bytes) -> tuple:
    number, model, width, height = b.take("iiQQ")
    if model not in CAMERA_MODELS:
        raise ValueError(f"camera {number} has the unknown model {model}")
    name, focal, terms = CAMERA_MODELS[model]
    values = b.take(f"{focal + 2 + terms}d")
    return number, name, width, height, values[0], values[focal - 1], values[focal], values[focal + 1], list(values[focal + 2 :])


def _image(b: _Bytes) -> tuple:
    number, *pose, camera = b.take("i7di")
    name = b.text()
    seen = b.array(np.dtype([("x", "<f8"), ("y", "<f8"), ("point_id", "<i8")]), b.take("Q")[0])
    return number, name, camera, *pose, [dict(zip(("x", "y", "point_id"), r, strict=True)) for r in seen.tolist()]


def _point(b: _Bytes) -> tuple:
    number, x, y, z, red, green, blue, error, length = b.take("Q3d3BdQ")
    track = b.array(np.dtype([("image_id", "<i4"), ("point_index", "<i4")]), length)
    return number, x, y, z, red, green, blue, error, [dict(zip(("image_id", "point_index"), r, strict=True)) for r in track.tolist()]


def _records(spark: SparkSession, path: str, schema: str, one) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                cursor, held = _Bytes(data.as_py()), []
                for _ in range(cursor.take("Q")[0]):
                    held.append(one(cursor))
                    if len(held) == _BATCH:
                        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in held], kind)
                        held = []
                yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in held], kind)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def colmap_cameras(spark: SparkSession, path: str) -> DataFrame:
    """The cameras of ``cameras.bin`` files: model, size, lens and distortion terms as stored."""
    return _records(spark, path, CAMERAS, _camera)


def colmap_images(spark: SparkSession, path: str) -> DataFrame:
    """The registered images of ``images.bin`` files: pose world-to-camera and 2-D points (point_id -1: no 3-D point)."""
    return _records(spark, path, IMAGES, _image)


def colmap_points(spark: SparkSession, path: str) -> DataFrame:
    """The points of ``points3D.bin`` files with colour, error and track."""
    return _records(spark, path, POINTS, _point)


def observations(points: DataFrame, images: DataFrame) -> DataFrame:
    """(name, image_id, point_id): which points each registered image sees, once for each entry of a track."""
    seen = points.select("point_id", F.explode("track.image_id").alias("image_id"))
    return seen.join(images.select("image_id", "name"), "image_id").select("name", "image_id", "point_id")


def posed_images(images: DataFrame, cameras: DataFrame, factor: int = 1, test_every: int = 8) -> DataFrame:
    """Images with lens (sizes divided by ``factor``), their place in the order of names and the split by it.

    The order is one row for each image, so its window is small next to their pixels; every
    ``test_every``-th image from the first on is for validation.
    """
    from pyspark.sql import Window

    lens = cameras.select("camera_id", "model", "distortion", *[(F.col(c) / factor).alias(c) for c in ("fx", "fy", "cx", "cy")], *[F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("width", "height")])
    rows = images.drop("points").join(lens, "camera_id")
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy("name", "image_id")) - 1)
    return rows.withColumn("split", F.when(F.pmod("place", F.lit(test_every)) == 0, "val").otherwise("train"))


def canonical(scene: DataFrame, coefficients: list[list[str]] | None = None) -> DataFrame:
    """Scene rows as the records of the usual splat PLY: x.., f_dc_*, f_rest_*, opacity, scale_*, rot_*, all floats.

    Scales are stored as logarithms, opacities as logits.  ``coefficients`` lists the columns of each
    channel's harmonics, constant first; the rest is stored channel after channel.  Without it the
    constants come from the colours c0..c2.  Rows with a value that isn't finite are left out.
    """
    logit = F.ln("opacity") - F.ln(1 - F.col("opacity"))
    constant = [F.col(own[0]) for own in coefficients] if coefficients else [(F.col(f"c{k}") - 0.5) / harmonics.C0 for k in range(3)]
    rest = [F.col(c) for own in coefficients or [] for c in own[1:]]
    made = {n: F.col(f"m{n}") for n in "xyz"} | {f"f_dc_{k}": c for k, c in enumerate(constant)} | {f"f_rest_{k}": c for k, c in enumerate(rest)}
    made |= {"opacity": logit} | {f"scale_{k}": F.ln(f"s{n}") for k, n in enumerate("xyz")} | {f"rot_{k}": F.col(f"q{n}") for k, n in enumerate("wxyz")}
    rows = scene.select(*[c.cast("float").alias(n) for n, c in made.items()])
    finite = [F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")) for n in made]
    keep = finite[0]
    for f in finite[1:]:
        keep = keep & f
    return rows.where(keep)


def from_canonical(records: DataFrame) -> DataFrame:
    """The inverse of ``canonical``: scene rows with colours c0..c2, unit quaternions and harmonics sh<channel>_<k>."""
    rest = sorted((c for c in records.columns if c.startswith("f_rest_")), key=lambda c: int(c[7:]))
    each = len(rest) // 3
    d = lambda c: F.col(c).cast("double")
    size = F.sqrt(sum((d(f"rot_{k}") * d(f"rot_{k}") for k in range(1, 4)), d("rot_0") * d("rot_0")))
    made = {f"m{n}": d(n) for n in "xyz"} | {f"q{n}": F.when(size > 0, d(f"rot_{k}") / size).otherwise(d(f"rot_{k}")) for k, n in enumerate("wxyz")}
    made |= {f"s{n}": F.exp(d(f"scale_{k}")) for k, n in enumerate("xyz")} | {"opacity": 1 / (1 + F.exp(-d("opacity")))}
    made |= {f"c{k}": 0.5 + harmonics.C0 * d(f"f_dc_{k}") for k in range(3)}
    made |= {f"sh{k}_{j}": d(f"f_dc_{k}" if j == 0 else rest[k * each + j - 1]) for k in range(3) for j in range(each + 1)}
    return records.select(*[c.alias(n) for n, c in made.items()])


def npz_rows(spark: SparkSession, path: str, arrays: dict[str, str], schema: str) -> DataFrame:
    """Rows of NPZ archives: ``arrays`` gives each column's array and index, like ``points[:,0]`` by ``"points:0"``.

    All arrays named must have the same first size; an archive that has no such array is an error.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                with np.load(io.BytesIO(data.as_py()), allow_pickle=False) as held:
                    parts = {}
                    for column, where in arrays.items():
                        name, _, index = where.partition(":")
                        array = held[name]
                        parts[column] = array.reshape(len(array), int(np.prod(array.shape[1:])))[:, int(index or 0)]
                if len({len(p) for p in parts.values()}) > 1:
                    raise ValueError(f"arrays of several sizes: {({n: len(p) for n, p in parts.items()})}")
                for a in range(0, len(next(iter(parts.values()))), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(parts[f.name][a : a + 50_000])).cast(f.type) for f in kind], schema=kind)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)
