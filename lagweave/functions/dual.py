"""Numbers that carry their slopes: a model written once for Columns and arrays gives its own exact derivatives."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Dual:
    """An array of values and, for each parameter, the array of its slopes."""

    __slots__ = ("slopes", "value")
    __array_ufunc__ = None  # arrays leave mixed operations to this class

    def __init__(self, value: np.ndarray, slopes: list[np.ndarray]):
        self.value, self.slopes = value, slopes

    def chained(self, value: np.ndarray, slope: np.ndarray) -> Dual:
        """A function's value, with its slope by this number."""
        return Dual(value, [slope * s for s in self.slopes])

    def __add__(self, other):
        if isinstance(other, Dual):
            return Dual(self.value + other.value, [a + b for a, b in zip(self.slopes, other.slopes, strict=True)])
        return Dual(self.value + other, self.slopes)

    __radd__ = __add__

    def __neg__(self):
        return Dual(-self.value, [-s for s in self.slopes])

    def __sub__(self, other):
        return self + -other

    def __rsub__(self, other):
        return -self + other

    def __mul__(self, other):
        if isinstance(other, Dual):
            return Dual(self.value * other.value, [a * other.value + b * self.value for a, b in zip(self.slopes, other.slopes, strict=True)])
        return Dual(self.value * other, [s * other for s in self.slopes])

    __rmul__ = __mul__

    def __truediv__(self, other):
        if isinstance(other, Dual):
            ratio = self.value / other.value
            return Dual(ratio, [(a - ratio * b) / other.value for a, b in zip(self.slopes, other.slopes, strict=True)])
        return self * (1.0 / other)

    def __rtruediv__(self, other):
        ratio = other / self.value
        return self.chained(ratio, -ratio / self.value)

    def __lt__(self, other):
        return self.value < (other.value if isinstance(other, Dual) else other)

    def __gt__(self, other):
        return self.value > (other.value if isinstance(other, Dual) else other)


def exp(x: Dual) -> Dual:
    e = np.exp(x.value)
    return x.chained(e, e)


def log(x: Dual) -> Dual:
    return x.chained(np.log(x.value), 1.0 / x.value)


def power(x, y):
    """x to the y; the exponent may carry slopes too."""
    if not isinstance(y, Dual):
        return x.chained(x.value**y, y * x.value ** (y - 1.0))
    return exp(y * log(x)) if isinstance(x, Dual) else y.chained(x**y.value, np.log(x) * x**y.value)


def choose(test: np.ndarray, x, y):
    """x where the test holds, y elsewhere, slopes likewise."""
    k = len((x if isinstance(x, Dual) else y).slopes)
    parts: Callable = lambda v: (v.value, v.slopes) if isinstance(v, Dual) else (v, [0.0] * k)
    (a, s), (b, t) = parts(x), parts(y)
    return Dual(np.where(test, a, b), [np.where(test, p, q) for p, q in zip(s, t, strict=True)])
