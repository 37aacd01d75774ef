"""Losses, regularisers, image metrics and colour operators as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splatloom.functions import losses as L
from splatloom.operators import images, ranks
from splatloom.sources import views as V
from splatloom.sources.tables import written

from . import rendering
from .common import r4


def loss_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Each component's mean loss of its first colour against the second, by every registered kind."""
    rows = V.gaussians(spark, folder)
    p, t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("c0"))), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("c1")))
    rows = rows.select("component_id", p.alias("p"), t.alias("t"), "e11", "mz", (F.col("mz") + F.col("e15")).alias("d"))
    pairs = {"bce_with_logits": ("e11", "t"), "inverse_depth": ("mz", "d"), "disparity": ("mz", "d"), "log_l1": ("mz", "d")}
    return rows.groupBy("component_id").agg(*[r4(F.avg(L.resolve(n)(*map(F.col, pairs.get(n, ("p", "t")))))).alias(n) for n in L.REGISTRY])


def loss_reductions(spark: SparkSession, folder: str) -> DataFrame:
    """Pearson loss, PSNR, masked mean and sum of the colour error of each component."""
    rows = V.gaussians(spark, folder)
    error, mask = L.l1(F.col("c0"), F.col("c1")), F.col("opacity") > 0.5
    return rows.groupBy("component_id").agg(r4(L.pearson(F.col("c0"), F.col("c1"), F.col("opacity") > 0.2)).alias("pearson"), r4(L.psnr(F.col("c0"), F.col("c1"))).alias("psnr"), r4(L.masked_mean(error, mask)).alias("masked"), r4(F.sum(error)).alias("total"))


def trimmed_mean(spark: SparkSession, folder: str) -> DataFrame:
    """The mean of each component's int(0.8 n) smallest colour errors."""
    rows = V.gaussians(spark, folder).select("component_id", "gaussian_id", L.l1(F.col("c0"), F.col("c1")).alias("error"))
    kept = ranks.smallest(rows, F.col("error"), F.floor(F.col("_n") * F.lit(0.8)), "gaussian_id", by="component_id")
    return kept.groupBy("component_id").agg(r4(F.avg("error")).alias("trimmed"))


def scene_regularisers(spark: SparkSession, folder: str) -> DataFrame:
    """Means of opacity and scale, excess scale, out-of-bound distance and thinnest axis of each component."""
    rows = V.gaussians(spark, folder)
    out = sum((F.greatest(F.abs(c) - 2, F.lit(0.0)) for c in map(F.col, ("my", "mz"))), F.greatest(F.abs("mx") - 2, F.lit(0.0)))
    return rows.groupBy("component_id").agg(
        r4(F.avg("opacity")).alias("opacity"), r4(F.avg((F.col("sx") + F.col("sy") + F.col("sz")) / 3)).alias("scale"), r4(F.sum(F.greatest(F.greatest("sx", "sy", "sz") - 0.1, F.lit(0.0)))).alias("excess"),
        r4(F.avg(out)).alias("out_of_bound"), r4(F.avg(F.least("sx", "sy", "sz"))).alias("thin"), r4(F.avg(1 - (F.col("qw") * F.col("qw")))).alias("turned"),
    )


def _image(spark: SparkSession, folder: str) -> DataFrame:
    return rendering.composite_rgb(spark, folder)


def ssim(spark: SparkSession, folder: str) -> DataFrame:
    """Each camera's mean structural similarity of its first two channels."""
    return images.ssim_map(_image(spark, folder), "c0", "c1").groupBy("camera_id").agg(F.count("*").alias("windows"), r4(F.avg("ssim")).alias("ssim"))


def tv_loss(spark: SparkSession, folder: str) -> DataFrame:
    return images.total_variation(_image(spark, folder), "c0").select("camera_id", r4("tv").alias("tv"))


def image_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """PSNR and L1 of two channels of each camera's image, and covered pixels."""
    return _image(spark, folder).groupBy("camera_id").agg(r4(L.psnr(F.col("c0"), F.col("c1"))).alias("psnr"), r4(F.avg(L.l1(F.col("c0"), F.col("c1")))).alias("l1"), F.sum((F.col("alpha") > 0.5).cast("long")).alias("covered"))


def color_affine(spark: SparkSession, folder: str) -> DataFrame:
    """The first channel corrected to look like the second."""
    return images.affine_correction(written(_image(spark, folder), "image"), "c0", "c1").select("camera_id", "x", "y", r4("corrected").alias("corrected"))


def ssim_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Each camera's mean structural similarity where the image is covered."""
    return images.masked_ssim(_image(spark, folder), "c0", "c1", F.col("alpha") > 0.5).groupBy("camera_id").agg(F.count("*").alias("windows"), r4(F.avg("ssim")).alias("ssim"))


def tv_temporal(spark: SparkSession, folder: str) -> DataFrame:
    """How much each camera's image differs from that of the camera before it; odd cameras are masked."""
    frames = _image(spark, folder).withColumn("mask", F.pmod(F.col("camera_id"), F.lit(2)).cast("double"))
    return images.temporal_variation(frames, "c0", "camera_id", "mask").select("frame", r4("tv").alias("tv"))


def sensor_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Each component's masked losses of distance, intensity, drops and background, paired disparity and sums of excess."""
    rows = V.gaussians(spark, folder).withColumns({"far": F.col("mz") + F.col("e15"), "valid": F.col("e5") > -0.1, "dropped": (F.col("e6") > 0).cast("double")})
    gap, both = L.disparity_pairs(F.when(F.col("e7") > 0.05, F.col("mz")).otherwise(0.0), F.when(F.col("e6") > 0.05, F.col("far")).otherwise(0.0))
    c = F.col
    return rows.groupBy("component_id").agg(
        r4(L.valid_mean("l1", c("mz"), c("far"), c("valid"))).alias("distance"), r4(L.valid_mean("mse", c("c0"), c("c1"), c("valid"))).alias("intensity"),
        r4(L.valid_mean("bce_with_logits", c("e11"), c("dropped"), c("valid"))).alias("raydrop"), r4(L.valid_mean("bce", c("opacity"), F.lit(0.0), c("valid") & (c("e4") > 0))).alias("background"),
        r4(F.sum(gap) / F.greatest(F.sum(both.cast("int")), F.lit(1))).alias("binocular"), r4(L.relu_sum(c("sx"), 0.1)).alias("excess"), r4(L.weights_reg(c("sx"), c("sy"), c("sz"))).alias("weights"),
        r4(F.avg(L.identity_distance(*[c(f"e{k}") for k in range(1, 13)]))).alias("drift"),
    )


def depth_normals(spark: SparkSession, folder: str) -> DataFrame:
    """Normals of the expected depth of every pixel."""
    depth = rendering.composite_depth(spark, folder).select("camera_id", "x", "y", F.col("expected_depth").alias("depth"))
    rows = images.normals(images.depth_points(depth, V.cameras(spark, folder)))
    return rows.select("camera_id", "x", "y", *[(F.round(f"n{a}", 3) + 0.0).alias(f"n{a}") for a in "xyz"])


QUERIES = {f.__name__: f for f in (loss_terms, loss_reductions, trimmed_mean, scene_regularisers, ssim, tv_loss, image_metrics, color_affine, ssim_masked, tv_temporal, sensor_losses, depth_normals)}

_C = "p as (select component_id, least(1, greatest(0, c0)) as p, least(1, greatest(0, c1)) as t, e11 as z, mz as a, mz + e15 as b from gaussians)"
_LOW = "greatest(case when {0} > 0 then ln({0}) else -100 end, -100)"
_BCE = lambda p: f"-(t*{_LOW.format(p)} + (1 - t)*{_LOW.format(f'(1 - {p})')})"
_CLIP = "least(1 - 1e-6, greatest(1e-6, p))"
_TERMS = {
    "l1": "abs(p - t)", "mse": "(p - t)*(p - t)", "huber": "case when abs(p - t) <= 0.1::double then 0.5::double*(p - t)*(p - t) else 0.1::double*(abs(p - t) - 0.05::double) end",
    "smooth_l1": "case when abs(p - t) < 0.1::double then 0.5::double*(p - t)*(p - t)/0.1::double else abs(p - t) - 0.05::double end", "bce": _BCE("p"), "bce_clipped": _BCE(_CLIP),
    "bce_with_logits": "greatest(z, 0) - z*t + ln(1 + exp(-abs(z)))", "log_l1": "ln(1 + abs(a - b))", "inverse_depth": "pow(1/greatest(a, 1e-6) - 1/greatest(b, 1e-6), 2)",
    "disparity": "abs(case when a > 0 then 1/a else 0 end - case when b > 0 then 1/b else 0 end)",
}
_IMAGE = f"image as ({rendering.SQL['composite_rgb']})"
_W = images.gaussian_window()
_ALONG = lambda c, part, order: " + ".join([f"{_W[0]!r}::double*{c}", *(f"{w!r}::double*lead({c}, {k}) over (partition by camera_id, {part} order by {order})" for k, w in enumerate(_W[1:], 1))])
_FIVE = ("ma", "mb", "aa", "bb", "ab")
SQL = {
    "loss_terms": f"with {V.GAUSSIANS}, {_C} select component_id, {', '.join(f'round(avg({v}), 4) + 0 as {k}' for k, v in _TERMS.items())} from p group by 1",
    "loss_reductions": f"""with {V.GAUSSIANS} select component_id, round(case when count(*) filter (where opacity > 0.2::double) < 2 then 0 else 1 - covar_pop(c0, c1) filter (where opacity > 0.2::double)*count(*) filter (where opacity > 0.2::double)/sqrt(greatest(var_pop(c0) filter (where opacity > 0.2::double)*var_pop(c1) filter (where opacity > 0.2::double)*pow(count(*) filter (where opacity > 0.2::double), 2), 1e-12)) end, 4) + 0 as pearson, round(-10*log10(avg((c0 - c1)*(c0 - c1))), 4) + 0 as psnr,
  round(sum(case when opacity > 0.5::double then abs(c0 - c1) else 0 end)/greatest(count(*) filter (where opacity > 0.5::double), 1), 4) + 0 as masked, round(sum(abs(c0 - c1)), 4) + 0 as total from gaussians group by 1""",
    "trimmed_mean": f"with {V.GAUSSIANS} select component_id, round(avg(err), 4) + 0 as trimmed from (select component_id, abs(c0 - c1) as err, row_number() over (partition by component_id order by abs(c0 - c1), gaussian_id) as r, count(*) over (partition by component_id) as k from gaussians) where r <= floor(k*0.8::double) group by 1",
    "scene_regularisers": f"""with {V.GAUSSIANS} select component_id, round(avg(opacity), 4) + 0 as opacity, round(avg((sx + sy + sz)/3), 4) + 0 as scale, round(sum(greatest(greatest(sx, sy, sz) - 0.1::double, 0)), 4) + 0 as excess,
  round(avg(greatest(abs(mx) - 2, 0) + greatest(abs(my) - 2, 0) + greatest(abs(mz) - 2, 0)), 4) + 0 as out_of_bound, round(avg(least(sx, sy, sz)), 4) + 0 as thin, round(avg(1 - qw*qw), 4) + 0 as turned from gaussians group by 1""",
    "ssim": f"""with {_IMAGE}, m as (select camera_id, x, y, c0 as ma, c1 as mb, c0*c0 as aa, c1*c1 as bb, c0*c1 as ab from image), h as (select camera_id, x, y, {', '.join(f'{_ALONG(c, "y", "x")} as {c}' for c in _FIVE)} from m),
v as (select camera_id, x, y, {', '.join(f'{_ALONG(c, "x", "y")} as {c}' for c in _FIVE)} from h where ma is not null)
select camera_id, count(*) as windows, round(avg(((2*ma*mb + 0.0001::double)*(2*(ab - ma*mb) + 0.0009::double))/((ma*ma + mb*mb + 0.0001::double)*(aa - ma*ma + bb - mb*mb + 0.0009::double))), 4) + 0 as ssim from v where ma is not null group by 1""",
    "tv_loss": f"with {_IMAGE} select camera_id, round(avg(r*r) + avg(d*d), 4) + 0 as tv from (select camera_id, lead(c0) over (partition by camera_id, y order by x) - c0 as r, lead(c0) over (partition by camera_id, x order by y) - c0 as d from image) group by 1",
    "image_metrics": f"with {_IMAGE} select camera_id, round(-10*log10(avg((c0 - c1)*(c0 - c1))), 4) + 0 as psnr, round(avg(abs(c0 - c1)), 4) + 0 as l1, count(*) filter (where alpha > 0.5::double) as covered from image group by 1",
    "color_affine": f"""with {_IMAGE}, f as (select camera_id, avg(c0) as mc, avg(c1) as mr, avg(c0*c1) as mcr, avg(c1*c1) as mrr from image group by 1),
g as (select camera_id, mc, mr, (mcr - mr*mc)/greatest(mrr - mr*mr, 1e-8) as a from f), h as (select camera_id, mc - a*mr as b, case when abs(a) < 1e-8 then 1 else a end as a from g)
select camera_id, x, y, round(greatest(0, least(1, (c0 - b)/a)), 4) + 0 as corrected from image join h using (camera_id)""",
    "ssim_masked": f"""with {_IMAGE}, z as (select camera_id, x, y, case when alpha > 0.5::double then c0 else 0 end as c0, case when alpha > 0.5::double then c1 else 0 end as c1 from image),
m as (select camera_id, x, y, c0 as ma, c1 as mb, c0*c0 as aa, c1*c1 as bb, c0*c1 as ab from z), h as (select camera_id, x, y, {', '.join(f'{_ALONG(c, "y", "x")} as {c}' for c in _FIVE)} from m),
v as (select camera_id, x, y, {', '.join(f'{_ALONG(c, "x", "y")} as {c}' for c in _FIVE)} from h where ma is not null)
select camera_id, count(*) as windows, round(avg(((2*ma*mb + 0.0001::double)*(2*(ab - ma*mb) + 0.0009::double))/((ma*ma + mb*mb + 0.0001::double)*(aa - ma*ma + bb - mb*mb + 0.0009::double))), 4) + 0 as ssim from v where ma is not null group by 1""",
    "tv_temporal": f"with {_IMAGE} select camera_id as frame, round(avg(d*d)*(camera_id % 2), 4) + 0 as tv from (select camera_id, c0 - lag(c0) over (partition by x, y order by camera_id) as d from image) where d is not null group by camera_id",
    "sensor_losses": f"""with {V.GAUSSIANS}, s as (select *, mz + e15 as far, e5 > -0.1::double as valid, case when e6 > 0 then 1 else 0 end as dropped, case when e7 > 0.05::double then mz else 0 end as p, case when e6 > 0.05::double then mz + e15 else 0 end as t from gaussians)
select component_id, round(coalesce(avg(abs(mz - far)) filter (where valid), 0), 4) + 0 as distance, round(coalesce(avg((c0 - c1)*(c0 - c1)) filter (where valid), 0), 4) + 0 as intensity,
  round(coalesce(avg(greatest(e11, 0) - e11*dropped + ln(1 + exp(-abs(e11)))) filter (where valid), 0), 4) + 0 as raydrop, round(coalesce(avg(-greatest(ln(1 - opacity), -100)) filter (where valid and e4 > 0), 0), 4) + 0 as background,
  round(sum(case when abs(p) > 1e-7 and abs(t) > 1e-7 then abs(1/p - 1/t) else 0 end)/greatest(count(*) filter (where abs(p) > 1e-7 and abs(t) > 1e-7), 1), 4) + 0 as binocular, round(sum(greatest(sx - 0.1::double, 0)), 4) + 0 as excess,
  round(avg(sx*sx + sy*sy + sz*sz), 4) + 0 as weights, round(avg(sqrt({' + '.join(f'pow(e{k} - {1 if (k - 1) // 4 == (k - 1) % 4 else 0}, 2)' for k in range(1, 13))})), 4) + 0 as drift from s group by 1""",
    "depth_normals": f"""with image as ({rendering.SQL['composite_depth']}), p as (select camera_id, x, y, (x + 0.5::double - 32)/60*d as px, (y + 0.5::double - 24)/60*d as py, d as pz from (select *, expected_depth as d from image)),
g as (select camera_id, x, y, {', '.join(f'lead(p{a}) over (partition by camera_id, {q} order by {o}) - lag(p{a}) over (partition by camera_id, {q} order by {o}) as {n}{a}' for n, q, o in (('u', 'y', 'x'), ('v', 'x', 'y')) for a in 'xyz')} from p),
k as (select camera_id, x, y, uy*vz - uz*vy as kx, uz*vx - ux*vz as ky, ux*vy - uy*vx as kz from g), l as (select *, sqrt(kx*kx + ky*ky + kz*kz) as l from k)
select camera_id, x, y, {', '.join(f'round(coalesce(case when l > 1e-12 then k{a}*(1/l) else k{a}*0 end, 0), 3) + 0 as n{a}' for a in 'xyz')} from l""",
}
