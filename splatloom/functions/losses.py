"""Unreduced losses of a prediction and a target, as Columns, and a registry of them by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Loss = Callable[[Column, Column], Column]


def l1(p: Column, t: Column) -> Column:
    return F.abs(p - t)


def mse(p: Column, t: Column) -> Column:
    return (p - t) * (p - t)


def huber(p: Column, t: Column, delta: float = 0.1) -> Column:
    gap = F.abs(p - t)
    return F.when(gap <= delta, 0.5 * gap * gap).otherwise(delta * (gap - 0.5 * delta))


def smooth_l1(p: Column, t: Column, beta: float = 0.1) -> Column:
    gap = F.abs(p - t)
    return F.when(gap < beta, 0.5 * gap * gap / beta).otherwise(gap - 0.5 * beta)


def bce(p: Column, t: Column) -> Column:
    """Binary cross entropy of probabilities; logarithms are cut off at -100."""
    low = lambda x: F.greatest(F.ln(x), F.lit(-100.0))
    return -(t * low(p) + (1 - t) * low(1 - p))


def bce_clipped(p: Column, t: Column, eps: float = 1e-6) -> Column:
    return bce(F.least(F.lit(1 - eps), F.greatest(F.lit(eps), p)), t)


def bce_with_logits(x: Column, t: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))


def log_l1(p: Column, t: Column) -> Column:
    return F.log1p(F.abs(p - t))


def inverse_depth(p: Column, t: Column, eps: float = 1e-6) -> Column:
    gap = 1 / F.greatest(p, F.lit(eps)) - 1 / F.greatest(t, F.lit(eps))
    return gap * gap


def disparity(p: Column, t: Column) -> Column:
    """L1 of inverse depths; a depth of 0 or less has inverse 0."""
    inverse = lambda x: F.when(x > 0, 1 / x).otherwise(F.lit(0.0))
    return F.abs(inverse(p) - inverse(t))


def disparity_pairs(p: Column, t: Column, eps: float = 1e-7) -> tuple[Column, Column]:
    """(L1 of inverse depths, whether the pair counts): both depths must be further from 0 than ``eps``."""
    valid = (F.abs(p) > eps) & (F.abs(t) > eps)
    return F.when(valid, F.abs(1 / p - 1 / t)).otherwise(F.lit(0.0)), valid


REGISTRY: dict[str, Loss] = {f.__name__: f for f in (l1, mse, huber, smooth_l1, bce, bce_clipped, bce_with_logits, log_l1, inverse_depth, disparity)}


def resolve(loss: str | Loss) -> Loss:
    """A loss by name, or any function of two Columns."""
    if callable(loss):
        return loss
    if loss not in REGISTRY:
        raise ValueError(f"unknown loss {loss!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[loss]


def masked_mean(value: Column, mask: Column) -> Column:
    """An aggregate: the mean over rows whose mask is set, 0 if there are none."""
    m = mask.cast("double")
    return F.sum(value * m) / F.greatest(F.sum(m), F.lit(1.0))


def pearson(p: Column, t: Column, mask: Column | None = None) -> Column:
    """An aggregate: 1 - correlation over the rows of the mask; 0 for fewer than two, 1 where either side is constant."""
    if mask is not None:
        p, t = F.when(mask, p), F.when(mask, t)
    n = F.count(F.when(p.isNotNull() & t.isNotNull(), 1))
    spread = F.sqrt(F.greatest(F.var_pop(p) * F.var_pop(t) * n * n, F.lit(1e-12)))
    return F.when(n < 2, F.lit(0.0)).otherwise(1 - F.covar_pop(p, t) * n / spread)


def valid_mean(loss: str | Loss, p: Column, t: Column, valid: Column) -> Column:
    """An aggregate: the mean loss over valid rows, 0 if there are none; for lidar distance, intensity, drops and background."""
    return F.coalesce(F.avg(F.when(valid, resolve(loss)(p, t))), F.lit(0.0))


def relu_sum(value: Column, eps: float) -> Column:
    """An aggregate: what values exceed ``eps`` by."""
    return F.sum(F.greatest(value - eps, F.lit(0.0)))


def weights_reg(*weights: Column) -> Column:
    """An aggregate: the mean squared length of the weights of a row."""
    return F.avg(sum((w * w for w in weights[1:]), weights[0] * weights[0]))


def identity_distance(*entries: Column, rows: int = 3, cols: int = 4) -> Column:
    """Frobenius distance of a ``rows`` x ``cols`` matrix, given row by row, from the identity."""
    gaps = [e - (1.0 if k // cols == k % cols else 0.0) for k, e in enumerate(entries[: rows * cols])]
    return F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))


def psnr(p: Column, t: Column) -> Column:
    """An aggregate: -10 log10 of the mean squared error, infinite where that is 0."""
    error = F.avg(mse(p, t))
    return F.when(error == 0, F.lit(float("inf"))).otherwise(-10 * F.log10(error))
