"""Algebra of probability vectors as column expressions; everything stays inside the JVM.

A vector is an ``array<double>`` in the order of its question's options; null means no answer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def lit(x: float) -> Column:
    return F.lit(float(x))


def total(p: Column) -> Column:
    return F.aggregate(p, lit(0), lambda a, x: a + x)


def normalise(p: Column) -> Column:
    """Divide by the sum; null for a vector without mass."""
    mass = total(p)
    return F.when(mass > 0, F.transform(p, lambda x: x / mass))


def argmax(p: Column) -> Column:
    """Index of the largest entry, the first of equals."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def at(p: Column, i: Column) -> Column:
    return F.get(p, i.cast("int"))


def top(p: Column) -> Column:
    return F.array_max(p)


def margin(p: Column) -> Column:
    """Largest entry less the second largest; the whole entry if there is no second."""
    ranked = F.sort_array(p, asc=False)
    return F.get(ranked, F.lit(0)) - F.coalesce(F.get(ranked, F.lit(1)), lit(0))


def shape_confidence(p: Column) -> Column:
    """1 - H(p) / ln k; 1 for fewer than two options."""
    clipped = F.transform(p, lambda x: F.least(F.greatest(x, lit(EPS)), lit(1)))
    entropy = F.aggregate(clipped, lit(0), lambda a, x: a - x * F.ln(x))
    return F.when(F.size(p) < 2, lit(1)).otherwise(1 - entropy / F.ln(F.size(p).cast("double")))


def expected_level(p: Column) -> Column:
    return F.aggregate(F.transform(p, lambda x, i: x * i), lit(0), lambda a, x: a + x)


def one_hot(i: Column, k: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.when(j == i, lit(1)).otherwise(lit(0)))


def softmax(z: Column) -> Column:
    peak = F.array_max(z)
    return normalise(F.transform(z, lambda x: F.exp(x - peak)))


def nll(p: Column, y: Column) -> Column:
    return -F.ln(F.least(F.greatest(at(p, y), lit(EPS)), lit(1)))


def brier(p: Column, y: Column) -> Column:
    """Squared distance to the one-hot truth, 0 to 2."""
    return F.aggregate(F.transform(p, lambda x, i: F.pow(x - F.when(i == y, lit(1)).otherwise(lit(0)), lit(2))), lit(0), lambda a, x: a + x)


def spherical_loss(p: Column, y: Column) -> Column:
    norm = F.sqrt(F.aggregate(p, lit(0), lambda a, x: a + x * x))
    return 1 - at(p, y) / norm


def rps(p: Column, y: Column) -> Column:
    """Ranked probability score of an ordinal answer: squared distances of the cumulative vectors over k - 1."""
    sums = F.transform(p, lambda x, i: F.pow(total(F.slice(p, F.lit(1), i + 1)) - F.when(i >= y, lit(1)).otherwise(lit(0)), lit(2)))
    return total(F.slice(sums, F.lit(1), F.size(p) - 1)) / (F.size(p) - 1)


def total_variation(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda a, b: F.abs(a - b))) / 2


def log_odds(p: Column) -> Column:
    """Log-odds of the stated confidence: P(yes) of two options, else the top entry."""
    c = F.when(F.size(p) == 2, F.get(p, F.lit(1))).otherwise(top(p))
    return F.ln(F.least(F.greatest(c, lit(EPS)), lit(1 - 1e-9)) / F.least(F.greatest(1 - c, lit(EPS)), lit(1)))


def rescale_top(p: Column, mapped: Column) -> Column:
    """Set the winner to ``mapped``, floored just above the runner-up, and the rest in proportion; the winner never changes."""
    win = argmax(p)
    peak = top(p)
    rest = total(p) - peak
    second = F.get(F.sort_array(p, asc=False), F.lit(1))
    floor = F.when(rest > EPS, second / (rest + second)).otherwise(lit(0))
    t = F.greatest(mapped, F.least(floor + 1e-9, lit(1 - EPS)))
    moved = F.transform(p, lambda x, i: F.when(i == win, t).when(rest > EPS, x * (1 - t) / rest).otherwise((1 - t) / (F.size(p) - 1)))
    return normalise(moved)


def temperature(p: Column, t: Column) -> Column:
    """Sharpen (t < 1) or flatten (t > 1)."""
    return softmax(F.transform(p, lambda x: F.ln(F.greatest(x, lit(EPS))) / t))


def platt(p: Column, a: Column, b: Column) -> Column:
    mapped = 1 / (1 + F.exp(-(a * log_odds(p) + b)))
    return F.when(F.size(p) == 2, F.array(1 - mapped, mapped)).otherwise(rescale_top(p, mapped))


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear through (xs, ys), flat beyond the ends."""
    n = F.size(xs)
    above = F.size(F.filter(xs, lambda v: v <= x))
    x0, x1 = F.get(xs, above - 1), F.get(xs, above)
    y0, y1 = F.get(ys, above - 1), F.get(ys, above)
    inside = F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return F.when(above == 0, F.get(ys, F.lit(0))).when(above >= n, F.get(ys, n - 1)).otherwise(inside)


def isotonic(p: Column, xs: Column, ys: Column) -> Column:
    c = F.when(F.size(p) == 2, F.get(p, F.lit(1))).otherwise(top(p))
    mapped = interpolate(c, xs, ys)
    return F.when(F.size(p) == 2, F.array(1 - mapped, mapped)).otherwise(rescale_top(p, mapped))


def full_map(p: Column, weights: Column, bias: Column) -> Column:
    """softmax(W ln p + b), ``weights`` as an array of rows (vector scaling is a diagonal W)."""
    z = F.transform(p, lambda x: F.ln(F.greatest(x, lit(EPS))))
    return softmax(F.zip_with(F.transform(weights, lambda row: total(F.zip_with(row, z, lambda a, b: a * b))), bias, lambda a, b: a + b))
