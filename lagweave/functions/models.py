"""Model functions of the fit, generic over Columns, NumPy arrays and arrays with slopes through a small set of operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dual
from .dual import Dual

W, A = 2.0 / 3.0, 4.0 / 3.0


def exp(x):
    if isinstance(x, Dual):
        return dual.exp(x)
    return F.exp(x) if isinstance(x, Column) else np.exp(x)


def power(x, y):
    if isinstance(x, Dual) or isinstance(y, Dual):
        return dual.power(x, y)
    return F.pow(x, y) if isinstance(x, Column) or isinstance(y, Column) else np.power(x, y)


def least(x, y):
    if isinstance(x, Dual) or isinstance(y, Dual):
        return dual.choose(~(x > y), x, y)
    return F.least(x, y) if isinstance(x, Column) else np.minimum(x, y)


def where(test, x, y):
    if isinstance(x, Dual) or isinstance(y, Dual):
        return dual.choose(test, x, y)
    if isinstance(test, Column):
        return F.when(test, x).otherwise(y)
    return np.where(test, x, y)


def zero_r1(x, f, phi, w=W):
    """No recombination."""
    return x * 0.0


def const_r1(x, f, phi, w=W):
    """Fragments of one size f."""
    return least(x * 1.0, f * (x * 0.0 + 1.0)) * (w * phi)


def exp_r1(x, f, phi, w=W):
    """Exponentially distributed fragments."""
    return (1.0 - exp(-x / f)) * (w * phi * f)


def geom_r1(x, f, phi, w=W):
    """Geometrically distributed fragments."""
    return (1.0 - power(1.0 - 1.0 / f, x)) * (w * phi * f)


R1 = {"const": const_r1, "exp": exp_r1, "geom": geom_r1, "zero": zero_r1}


def register_r1(name: str, f) -> None:
    """Make f(x, f, phi, w) available as r1=name in curves and fits.

    It is written once with +, -, *, / and this module's exp, power, least and where, and then works on Columns, on
    arrays and, for the fits' slopes, on arrays with slopes.
    """
    if name in R1 and R1[name] is not f:
        raise ValueError(f"there is an r1 named {name} already")
    R1[name] = f


def r1_of(r1):
    """The function of a name, or the function itself."""
    if callable(r1):
        return r1
    if r1 not in R1:
        raise ValueError(f"r1 is a function or one of {', '.join(R1)}")
    return R1[r1]


def calc_p2(theta, r1, r2, ds, a=A):
    """Probability of differing at both of two sites, given the rates r1 (one site's fragment) and r2 (shared)."""
    s = 1.0 + r1 + r2 + a * theta
    both = r1 + r2
    inner = r2 * theta * theta + ds * ds * s * (2.0 * r1 * r1 + r2 + 3.0 * r1 * r2 + r2 * r2 + a * (r1 + 2.0 * r2) * theta)
    inner = inner - ds * theta * (2.0 * r2 + both * both + a * (r1 + 3.0 * r2) * theta)
    above = 2.0 * (r2 * theta + ds * r1 * s) * inner
    below = both * both * (1.0 + 2.0 * r1 + r2 + 2.0 * a * theta) * (ds * (2.0 * r1 + a * theta) * s - theta * (r1 - r2 + a * theta))
    return above / below


def model_curve(x, theta, phi, f, ds, r1="const", w=W, a=A):
    """The profile's P2 at distance x over ds."""
    first = r1_of(r1)(x, f, phi, w)
    return calc_p2(theta, first, phi * w * f - first, ds, a) / ds


def theta_pool(theta, phi, f, ds, w=W, a=A):
    return (ds * (1.0 + phi * w * f + a * theta) - theta) / ((1.0 - a * ds) * (phi * w * f + a * theta) - a * ds)


def derived(theta, phi, f, ds, w=W, a=A) -> dict:
    """Parameters that follow from the fitted ones; 0/0 where a fit ends at theta 0 is left to the caller."""
    pool = theta_pool(theta, phi, f, ds, w, a)
    phi_pool = phi * pool / theta
    return {"theta_pool": pool, "phi_pool": phi_pool, "ratio": phi_pool / pool, "rho": phi_pool * f, "c": w * phi * f / (1.0 + w * phi * f + theta * a), "d_pool": pool / (1.0 + a * pool), "d_clonal": theta / (1.0 + a * theta)}


def diversity(theta, a=A):
    return theta / (1.0 + a * theta)


def coalescent_curve(x, theta_s, phi_s, theta_p, phi_p, f, ds, w=W, a=A):
    """Alternative model: sample pairs by how many of the two sites came in by recombination, each class with its P2."""
    near = x < f
    both = 1.0 + 2.0 * theta_s * a + phi_s * w * (f + x)
    one = where(near, 2.0 * phi_s * w * x / both, 2.0 * phi_s * w * x / (1.0 + 2.0 * theta_s * a + phi_s * w + x * 0.0))
    two = where(near, phi_s * w * (f - x) / both, x * 0.0)
    pool = 2.0 * diversity(theta_p, a) * diversity(theta_p, a) * ((1.0 + theta_p * a + phi_p * w * x) / (1.0 + 2.0 * theta_p * a + 2.0 * phi_p * w * x))
    return ((1.0 - one - two) * diversity(2.0 * theta_s, a) * ds + one * ds * diversity(theta_p, a) + two * pool) / ds
