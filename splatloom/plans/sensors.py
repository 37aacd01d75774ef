"""Lenses, lidar elements, unprojection, sampling and classifications as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splatloom.functions import lenses
from splatloom.functions import rotation as R
from splatloom.operators import composite as C
from splatloom.operators import images
from splatloom.sources import views as V

from . import rendering
from .common import r4

#: Fixed values of the sample sensors.
FISHEYE, FISHEYE_MOST = (0.02, -0.01, 0.003, -0.0005), 1.5
FTHETA, FTHETA_AFFINE, FTHETA_MOST = (0.0, 55.0, 1.5, -0.8, 0.1), (1.01, 0.002, -0.003), 1.2
WINDSHIELD_H, WINDSHIELD_V = (0.001, 0.99, 0.01, 0.02, -0.01, 0.005), (-0.002, 0.01, 0.004, 1.01, 0.02, -0.006)


def fisheye_lens(spark: SparkSession, folder: str) -> DataFrame:
    """Image points through an odd polynomial of the angle to the axis."""
    rows = V.gaussians(spark, folder).select("gaussian_id", "mx", "my", lenses.angle_to_axis(F.col("mx"), F.col("my"), F.col("mz")).alias("t"), F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my")).alias("flat"))
    rows = rows.withColumn("d", lenses.odd_polynomial(F.col("t"), FISHEYE) / F.col("flat"))
    x, y = 60 * F.col("mx") * F.col("d") + 32, 60 * F.col("my") * F.col("d") + 24
    return rows.select("gaussian_id", r4(x).alias("x"), r4(y).alias("y"), ((F.col("t") < FISHEYE_MOST) & (x >= 0) & (x < 64) & (y >= 0) & (y < 48)).alias("valid"))


def ftheta_lens(spark: SparkSession, folder: str) -> DataFrame:
    """Image points through a polynomial of the clamped angle and an affine map, and the angle found back by 8 Newton steps."""
    rows = V.gaussians(spark, folder).select("gaussian_id", "mx", "my", lenses.angle_to_axis(F.col("mx"), F.col("my"), F.col("mz")).alias("t"), F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my")).alias("flat"))
    rows = rows.withColumn("r", lenses.polynomial(F.least("t", F.lit(FTHETA_MOST)), FTHETA))
    u, v = F.col("r") * F.col("mx") / F.col("flat"), F.col("r") * F.col("my") / F.col("flat")
    c, d, e = FTHETA_AFFINE
    back = lenses.inverse_by_newton(F.col("r"), FTHETA, 8, F.col("r") / FTHETA[1])
    return rows.select("gaussian_id", r4(c * u + d * v + 32).alias("x"), r4(e * u + v + 24).alias("y"), r4(back).alias("angle"), (F.col("t") < FTHETA_MOST).alias("valid"))


def windshield(spark: SparkSession, folder: str) -> DataFrame:
    """Directions bent by two polynomials of their horizontal and vertical angle."""
    d = R.normalised(R.columns("mx", "my", "mz"))
    rows = V.gaussians(spark, folder).select("gaussian_id", F.asin(d[0]).alias("h"), F.asin(d[1]).alias("v"), F.signum("mz").alias("side"))
    rows = rows.select("gaussian_id", "side", F.sin(lenses.bivariate(F.col("h"), F.col("v"), WINDSHIELD_H)).alias("x"), F.sin(lenses.bivariate(F.col("h"), F.col("v"), WINDSHIELD_V)).alias("y"))
    z = F.col("side") * F.sqrt(1 - F.least(F.lit(1.0), F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    return rows.select("gaussian_id", r4("x").alias("x"), r4("y").alias("y"), r4(z).alias("z"))


def lidar_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Ray and time share of every element of a 16 x 90 spinning lidar on each camera's mount."""
    mounts = V.cameras(spark, folder)
    rows = mounts.select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(89))).alias("col"))
    elevation = F.lit(-0.4) + F.col("row") * F.lit(0.05)
    azimuth = F.lit(3.0) - F.col("col") * F.lit(0.066) + F.col("row") * F.lit(0.001)
    rows = rows.select("camera_id", "row", "col", *[f"r{i}{j}" for i in range(3) for j in range(3)], *[c.alias(n) for n, c in zip("xyz", lenses.direction(elevation, azimuth), strict=True)])
    view = tuple(R.columns(f"r{i}0", f"r{i}1", f"r{i}2") for i in range(3))
    world = R.apply(R.transposed(view), R.columns("x", "y", "z"))
    return rows.select("camera_id", "row", "col", *[r4(c).alias(f"ray{k}") for k, c in enumerate(world)], r4(F.col("col") / 89).alias("time"))


def unprojected_depth(spark: SparkSession, folder: str) -> DataFrame:
    """World points of pixels that are more than half covered, at their expected depth."""
    cameras = V.cameras(spark, folder)
    image = C.composite(rendering.weighted_pairs(spark, folder), C.pixels(cameras), ["depth"]).where("alpha > 0.5")
    rows = images.depth_points(image.select("camera_id", "x", "y", (F.col("depth") / F.col("alpha")).alias("depth")), cameras).join(cameras, "camera_id")
    view = tuple(R.columns(f"r{i}0", f"r{i}1", f"r{i}2") for i in range(3))
    world = R.apply(R.transposed(view), tuple(F.col(f"p{a}") - F.col(f"t{k}") for k, a in enumerate("xyz")))
    return rows.select("camera_id", "x", "y", *[r4(c).alias(f"w{a}") for a, c in zip("xyz", world, strict=True)])


def weighted_sample(spark: SparkSession, folder: str) -> DataFrame:
    """100 primitives drawn without replacement by opacity: an exponential race on hashed uniform numbers."""
    u = (F.conv(F.substring(F.md5(F.col("gaussian_id").cast("string")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    rows = V.gaussians(spark, folder).select("gaussian_id", (-F.ln(u) / F.col("opacity")).alias("arrival"))
    return rows.orderBy("arrival", "gaussian_id").limit(100).select("gaussian_id", r4("arrival").alias("arrival"))


def cross_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Mean softmax cross entropy of three channels taken as logits, and mean cosine loss of the normal to the view."""
    rows = V.gaussians(spark, folder)
    picked = F.element_at(F.array("c0", "c1", "c2"), F.pmod("component_id", F.lit(3)) + 1)
    loss = F.ln(F.exp("c0") + F.exp("c1") + F.exp("c2")) - picked
    turn = R.rotation(R.columns("qw", "qx", "qy", "qz"))
    view = R.normalised(R.columns("mx", "my", "mz"))
    rows = rows.select("component_id", loss.alias("loss"), (1 - R.dot((turn[0][2], turn[1][2], turn[2][2]), view)).alias("cosine"))
    return rows.groupBy("component_id").agg(r4(F.avg("loss")).alias("cross_entropy"), r4(F.avg("cosine")).alias("cosine"))


QUERIES = {f.__name__: f for f in (fisheye_lens, ftheta_lens, windshield, lidar_elements, unprojected_depth, weighted_sample, cross_entropy)}


def _horner(x: str, coefficients) -> str:
    out = f"{coefficients[-1]}::double"
    for c in reversed(coefficients[:-1]):
        out = f"({out}*{x} + {c}::double)"
    return out


def _newton(steps: int) -> str:
    sql = f"select *, r/{FTHETA[1]}::double as g from rr"
    slope = [k * c for k, c in enumerate(FTHETA)][1:]
    for _ in range(steps):
        sql = f"select * exclude (g), g - ({_horner('g', FTHETA)} - r)/{_horner('g', slope)} as g from ({sql})"
    return sql


_PLANE = "p as (select *, atan2(sqrt(mx*mx + my*my), mz) as t, sqrt(mx*mx + my*my) as flat from gaussians)"
_TWO = lambda c: f"{_horner('h', c[:3])} + {_horner('h', c[3:5])}*v + {c[5]}::double*v*v"
SQL = {
    "fisheye_lens": f"""with {V.GAUSSIANS}, {_PLANE}, i as (select gaussian_id, t, 60*mx*(t*{_horner('(t*t)', (1.0, *FISHEYE))}/flat) + 32 as x, 60*my*(t*{_horner('(t*t)', (1.0, *FISHEYE))}/flat) + 24 as y from p)
select gaussian_id, round(x, 4) + 0 as x, round(y, 4) + 0 as y, t < 1.5::double and x >= 0 and x < 64 and y >= 0 and y < 48 as valid from i""",
    "ftheta_lens": f"""with {V.GAUSSIANS}, {_PLANE}, rr as (select *, {_horner('least(t, 1.2::double)', FTHETA)} as r from p), b as ({_newton(8)})
select gaussian_id, round(1.01::double*(r*mx/flat) + 0.002::double*(r*my/flat) + 32, 4) + 0 as x, round(-0.003::double*(r*mx/flat) + r*my/flat + 24, 4) + 0 as y, round(g, 4) + 0 as angle, t < 1.2::double as valid from b""",
    "windshield": f"""with {V.GAUSSIANS}, a as (select gaussian_id, sign(mz) as side, asin(mx/sqrt(mx*mx + my*my + mz*mz)) as h, asin(my/sqrt(mx*mx + my*my + mz*mz)) as v from gaussians), d as (select *, sin({_TWO(WINDSHIELD_H)}) as x, sin({_TWO(WINDSHIELD_V)}) as y from a)
select gaussian_id, round(x, 4) + 0 as x, round(y, 4) + 0 as y, round(side*sqrt(1 - least(1, x*x + y*y)), 4) + 0 as z from d""",
    "lidar_elements": f"""with {V.CAMERAS}, e as (select *, cos(el)*cos(az) as x, cos(el)*sin(az) as y, sin(el) as z from (select c.*, i::int as row, j::int as col, -0.4::double + i*0.05::double as el, 3 - j*0.066::double + i*0.001::double as az from cameras c, unnest(range(16)) u(i), unnest(range(90)) v(j)))
select camera_id, row, col, {', '.join(f'round(r0{k}*x + r1{k}*y + r2{k}*z, 4) + 0 as ray{k}' for k in range(3))}, round(col/89::double, 4) + 0 as time from e""",
    "unprojected_depth": f"""with {rendering.PLAIN}{rendering.blend()}{rendering.GRID}, image as ({rendering.image('grid', 'alpha, depth/alpha as d')}),
p as (select c.*, i.x, i.y, (i.x + 0.5::double - cx)/fx*d as px, (i.y + 0.5::double - cy)/fy*d as py, d as pz from image i join cameras c on c.camera_id = i.camera_id where alpha > 0.5::double)
select camera_id, x, y, {', '.join(f'round(r0{k}*px + r1{k}*py + r2{k}*pz, 4) + 0 as w{a}' for k, a in enumerate('xyz'))} from p""",
    "weighted_sample": f"""with {V.GAUSSIANS}, k as (select gaussian_id, -ln((('0x' || substr(md5(gaussian_id::varchar), 1, 8))::bigint + 0.5::double)/4294967296::double)/opacity as arrival from gaussians)
select gaussian_id, round(arrival, 4) + 0 as arrival from k order by k.arrival, gaussian_id limit 100""",
    "cross_entropy": f"""with {V.GAUSSIANS} select component_id, round(avg(ln(exp(c0) + exp(c1) + exp(c2)) - case component_id % 3 when 0 then c0 when 1 then c1 else c2 end), 4) + 0 as cross_entropy,
  round(avg(1 - (2*(qx*qz + qw*qy)*mx + 2*(qy*qz - qw*qx)*my + (1 - 2*(qx*qx + qy*qy))*mz)/sqrt(mx*mx + my*my + mz*mz)), 4) + 0 as cosine from gaussians group by 1""",
}
