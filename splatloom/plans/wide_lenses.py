"""Projection and rendering through fisheye and F-Theta lenses by the unscented transform."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splatloom.operators import composite as C
from splatloom.operators.render import rasterize
from splatloom.operators.unscented import project_unscented
from splatloom.sources import views as V

from . import rays, rendering, sensors
from .common import r4

FISHEYE = {"radial": sensors.FISHEYE, "most": 1.2}
FTHETA = {"polynomial": sensors.FTHETA, "affine": sensors.FTHETA_AFFINE, "most": sensors.FTHETA_MOST}


def _seen(spark: SparkSession, folder: str, **lens) -> DataFrame:
    return rays._named(project_unscented(rays._scene(spark, folder), V.cameras(spark, folder), **lens))


def project_ut_fisheye(spark: SparkSession, folder: str) -> DataFrame:
    """Primitives through fisheye lenses with four radial coefficients."""
    return _seen(spark, folder, model="fisheye", distortion=FISHEYE)


def project_ut_ftheta(spark: SparkSession, folder: str) -> DataFrame:
    """Primitives through F-Theta lenses with an affine part."""
    return _seen(spark, folder, model="ftheta", distortion=FTHETA)


def render_ftheta(spark: SparkSession, folder: str) -> DataFrame:
    """The rendering entry through F-Theta lenses: colours before a background, and expected depth."""
    out = rasterize(V.gaussians(spark, folder), V.cameras(spark, folder), "RGB+ED", background=rendering.BACK, unscented=True, model="ftheta", distortion=FTHETA)
    return out.select(*C.PIXEL, "n", *[r4(c).alias(c) for c in ("alpha", "c0", "c1", "c2", "depth")])


QUERIES = {f.__name__: f for f in (project_ut_fisheye, project_ut_ftheta, render_ftheta)}
_FLAT = "greatest(sqrt(k{k}0*k{k}0 + k{k}1*k{k}1), 0.0000000000000002220446049250313::double)"


def _angles(most: float) -> str:
    return f"{_FLAT} as f{{k}}, atan2({_FLAT}, k{{k}}2) as w{{k}}, least(atan2({_FLAT}, k{{k}}2), {most}::double) as t{{k}}"


_RADIAL = f"(t{{k}}*{sensors._horner('(t{k}*t{k})', (1.0, *sensors.FISHEYE))}/f{{k}})"
_C, _D, _E = (f"{v}::double" for v in sensors.FTHETA_AFFINE)
_PIXELS = f"({sensors._horner('t{k}', sensors.FTHETA)}/f{{k}})"
_FISHEYE = rays._unscented(False, _angles(FISHEYE["most"]), f"fx*{_RADIAL}*k{{k}}0 + cx as x{{k}}, fy*{_RADIAL}*k{{k}}1 + cy as y{{k}}, k{{k}}2 > 0 and {_RADIAL} > 0 and w{{k}} < {FISHEYE['most']}::double as o{{k}}")
_FTHETA = rays._unscented(False, _angles(FTHETA["most"]), f"{_C}*{_PIXELS}*k{{k}}0 + {_D}*{_PIXELS}*k{{k}}1 + cx as x{{k}}, {_E}*{_PIXELS}*k{{k}}0 + {_PIXELS}*k{{k}}1 + cy as y{{k}}, w{{k}} < {FTHETA['most']}::double as o{{k}}")
# The opacity in the blend is the stored one, as with the other projections.
_SLIM = "seen_ as (select camera_id, gaussian_id, opacity, c0, c1, c2, width, height, mean2d_x, mean2d_y, depth, conic_a, conic_b, conic_c, radius_x, radius_y from seen)"
SQL = {
    "project_ut_fisheye": f"with {_FISHEYE} {rays._SHOW}",
    "project_ut_ftheta": f"with {_FTHETA} {rays._SHOW}",
    "render_ftheta": f"with {_FTHETA}, {_SLIM}{rendering.blend().replace('from seen s', 'from seen_ s')}{rendering.GRID} {rendering.image('grid', 'n, ' + rendering._rounded('alpha') + ', ' + rendering._BACKED + ', round(depth / greatest(alpha, 1e-10), 4) + 0 as depth')}",
}
