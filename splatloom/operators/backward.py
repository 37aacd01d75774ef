"""Backward of the projection: slopes on the screen carried back to primitives and cameras.

A row of slopes for each camera and primitive is joined back to both; every stage computes the adjoints of one
step of the projection from those of the step after it, as columns.  What belongs to a primitive is then summed over its
cameras, and what belongs to a camera over its primitives, with partial sums before either shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splatloom.functions import rotation as R

from .project import computed

CENTRE, TURN, SIZE = ("mx", "my", "mz"), ("qw", "qx", "qy", "qz"), ("sx", "sy", "sz")
POSE = (*(f"r{i}{j}" for i in range(3) for j in range(3)), "t0", "t1", "t2")
SLOPES = ("v_mean_x", "v_mean_y", "v_conic_a", "v_conic_b", "v_conic_c", "v_depth")


def _grid(name: str, rows: int = 3, columns: int = 3) -> list[list[Column]]:
    return [[F.col(f"{name}{i}{j}") for j in range(columns)] for i in range(rows)]


def _names(name: str, values: list[list[Column]]) -> list[Column]:
    return [v.alias(f"{name}{i}{j}") for i, row in enumerate(values) for j, v in enumerate(row)]


def _product(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
    return [[R.dot(tuple(row), tuple(b[k][j] for k in range(len(b)))) for j in range(len(b[0]))] for row in a]


def _flip(a: list[list[Column]]) -> list[list[Column]]:
    return [list(row) for row in zip(*a, strict=True)]


def _lens(model: str) -> tuple[list[Column], list[list[Column]], list[Column]]:
    """(columns to keep, Jacobian, what the slopes of mean, Jacobian and depth give to the point in the camera).

    Of a pinhole, the Jacobian's slope x / z stays within the view widened by 30 %; outside, it does not move with x.
    """
    zero, x, y, z, fx, fy = F.lit(0.0), *R.columns("px", "py", "pz", "fx", "fy")
    to_mean, depth = R.columns("v_mean_x", "v_mean_y"), F.col("v_depth")
    if model == "ortho":
        return [], [[fx, zero, zero], [zero, fy, zero]], [to_mean[0] * fx, to_mean[1] * fy, depth]
    if model != "pinhole":
        raise ValueError(f"no backward of the {model} lens")
    held, ends, moves = [], [], []
    for f, p, c, size, name in ((fx, x, F.col("cx"), F.col("width"), "x"), (fy, y, F.col("cy"), F.col("height"), "y")):
        wide = 0.15 * size / f
        slope = F.least((size - c) / f + wide, F.greatest(-(c / f + wide), p / z))
        held += [slope.alias(f"slope_{name}"), (slope == p / z).alias(f"free_{name}")]
        ends.append(F.col(f"slope_{name}"))
        moves.append(F.when(F.col(f"free_{name}"), 1.0).otherwise(0.0))
    jacobian = [[fx / z, zero, -fx * ends[0] / z], [zero, fy / z, -fy * ends[1] / z]]
    by = _grid("vj", 2)
    to_x = to_mean[0] * fx / z - moves[0] * by[0][2] * fx / (z * z)
    to_y = to_mean[1] * fy / z - moves[1] * by[1][2] * fy / (z * z)
    to_z = depth - (to_mean[0] * fx * x + to_mean[1] * fy * y + by[0][0] * fx + by[1][1] * fy) / (z * z)
    to_z = to_z + (by[0][2] * fx * ends[0] * (1 + moves[0]) + by[1][2] * fy * ends[1] * (1 + moves[1])) / (z * z)
    return held, jacobian, [to_x, to_y, to_z]


def projection_slopes(slopes: DataFrame, gaussians: DataFrame, cameras: DataFrame, model: str = "pinhole", blur: float = 0.3) -> DataFrame:
    """(camera_id, gaussian_id, v_mx..mz, v_qw..qz, v_sx..sz, v_r00..r22, v_t0..t2) of each row of ``slopes``.

    ``slopes`` has derivatives by the columns of a projection: ``v_mean_x``, ``v_mean_y``, ``v_conic_a``, ``v_conic_b``,
    ``v_conic_c`` and ``v_depth``; those that are missing or null are 0.  Quaternions need not be of length 1.  Entries of a
    camera's rotation count as independent of each other.  Rows whose primitive or camera is missing are left out.
    """
    known = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in slopes.columns else F.lit(0.0).alias(c) for c in SLOPES]
    rows = slopes.select("camera_id", "gaussian_id", *known).join(gaussians.select("gaussian_id", *CENTRE, *TURN, *SIZE), "gaussian_id")
    lens = ["fx", "fy", "cx", "cy", "width", "height"]
    rows = rows.join(cameras.select("camera_id", *POSE, *lens), "camera_id")
    ids, base = ["camera_id", "gaussian_id"], [*CENTRE, *SIZE, *POSE, *SLOPES]
    long = R.norm(R.columns(*TURN))
    rows = computed(rows, *ids, *base, *lens, long.alias("long"), *[(F.col(c) / long).alias(c) for c in TURN])
    view, m = _grid("r"), R.columns(*CENTRE)
    base += [*TURN, "long"]
    turned = [list(row) for row in R.rotation(R.columns(*TURN))]
    rows = computed(rows, *ids, *base, *lens, *_names("g", turned), *[(R.dot(tuple(view[i]), m) + F.col(f"t{i}")).alias(n) for i, n in enumerate(("px", "py", "pz"))])
    turned = _grid("g")
    base += [f"g{i}{j}" for i in range(3) for j in range(3)]
    held, jacobian, to_point = _lens(model)
    # The body is the primitive's turn times its sizes; w holds it as the camera sees it.
    body = [[turned[i][k] * F.col(SIZE[k]) for k in range(3)] for i in range(3)]
    rows = computed(rows, *ids, *base, "fx", "fy", "px", "py", "pz", *held, *_names("w", _product(view, body)))
    base += ["fx", "fy", "px", "py", "pz", *[f"{a}_{n}" for a in ("slope", "free") for n in "xy" if held], *(f"w{i}{j}" for i in range(3) for j in range(3))]
    rows = computed(rows, *ids, *base, *_names("j", jacobian))
    jacobian, seen = _grid("j", 2), _grid("w")
    base += [f"j{i}{j}" for i in range(2) for j in range(3)]
    rows = computed(rows, *ids, *base, *_names("f", _product(jacobian, seen)))
    flat = _grid("f", 2)
    base += [f"f{i}{j}" for i in range(2) for j in range(3)]
    square = lambda i, j: R.dot(tuple(flat[i]), tuple(flat[j]))
    rows = computed(rows, *ids, *base, (square(0, 0) + blur).alias("a"), square(0, 1).alias("b"), (square(1, 1) + blur).alias("c"))
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    rows = computed(rows, *ids, *base, (F.col("c") / det).alias("x0"), (-F.col("b") / det).alias("x1"), (F.col("a") / det).alias("x2"))
    # The inverse moves by -X d X; the conic's middle entry stands for both of its places.
    inverse = [[F.col("x0"), F.col("x1")], [F.col("x1"), F.col("x2")]]
    by = [[F.col("v_conic_a"), F.col("v_conic_b") / 2], [F.col("v_conic_b") / 2, F.col("v_conic_c")]]
    rows = computed(rows, *ids, *base, *_names("h", _product(_product(inverse, by), inverse)))
    to_flat = [[-2 * v for v in row] for row in _product(_grid("h", 2, 2), flat)]
    rows = computed(rows, *ids, *base, *_names("vf", to_flat))
    to_flat = _grid("vf", 2)
    rows = computed(rows, *ids, *base, *_names("vj", _product(to_flat, _flip(seen))), *_names("vw", _product(_flip(jacobian), to_flat)))
    base = [*CENTRE, *TURN, *SIZE, *POSE, "long", *(f"{n}{i}{j}" for n in ("g", "vw") for i in range(3) for j in range(3))]
    rows = computed(rows, *ids, *base, *[v.alias(f"vp{k}") for k, v in enumerate(to_point)])
    point, to_seen = R.columns("vp0", "vp1", "vp2"), _grid("vw")
    to_body, by_view = _product(_flip(view), to_seen), _product(to_seen, _flip(body))
    poses = [(point[i] * m[j] + by_view[i][j]).alias(f"v_r{i}{j}") for i in range(3) for j in range(3)] + [point[i].alias(f"v_t{i}") for i in range(3)]
    centres = [R.dot(tuple(view[i][j] for i in range(3)), point).alias(f"v_{n}") for j, n in enumerate(CENTRE)]
    rows = computed(rows, *ids, *TURN, *SIZE, "long", *(f"g{i}{j}" for i in range(3) for j in range(3)), *poses, *centres, *_names("vb", to_body))
    to_body = _grid("vb")
    sizes = [R.dot(tuple(to_body[j][k] for j in range(3)), tuple(turned[j][k] for j in range(3))).alias(f"v_{n}") for k, n in enumerate(SIZE)]
    done = [*(f"v_{c}" for c in POSE), *(f"v_{c}" for c in CENTRE)]
    rows = computed(rows, *ids, *TURN, "long", *done, *sizes, *_names("d", [[to_body[j][k] * F.col(SIZE[k]) for k in range(3)] for j in range(3)]))
    d, (w, x, y, z) = _grid("d"), R.columns(*TURN)
    odd, even = (lambda i, j: d[i][j] - d[j][i]), (lambda i, j: d[i][j] + d[j][i])
    unit = [
        2 * (x * odd(2, 1) + y * odd(0, 2) + z * odd(1, 0)),
        2 * (w * odd(2, 1) + y * even(0, 1) + z * even(0, 2) - 2 * x * (d[1][1] + d[2][2])),
        2 * (w * odd(0, 2) + x * even(0, 1) + z * even(1, 2) - 2 * y * (d[0][0] + d[2][2])),
        2 * (w * odd(1, 0) + x * even(0, 2) + y * even(1, 2) - 2 * z * (d[0][0] + d[1][1])),
    ]
    done += [f"v_{c}" for c in SIZE]
    rows = computed(rows, *ids, *TURN, "long", *done, *[u.alias(f"u{k}") for k, u in enumerate(unit)])
    unit, q = R.columns("u0", "u1", "u2", "u3"), R.columns(*TURN)
    return rows.select(*ids, *done, *[((unit[k] - q[k] * R.dot(q, unit)) / F.col("long")).alias(f"v_{n}") for k, n in enumerate(TURN)])


def to_primitives(rows: DataFrame) -> DataFrame:
    """(gaussian_id, v_mx.., v_qw.., v_sx..): ``projection_slopes`` summed over the cameras."""
    return rows.groupBy("gaussian_id").agg(*[F.sum(f"v_{c}").alias(f"v_{c}") for c in (*CENTRE, *TURN, *SIZE)])


def to_cameras(rows: DataFrame) -> DataFrame:
    """(camera_id, v_r00.., v_t0..): ``projection_slopes`` summed over the primitives."""
    return rows.groupBy("camera_id").agg(*[F.sum(f"v_{c}").alias(f"v_{c}") for c in POSE])
