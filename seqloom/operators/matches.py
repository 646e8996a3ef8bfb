"""Tail of the number of matches under a random assignment, for many rows: no long numbers, and no signed sums."""

from __future__ import annotations

from math import ceil, exp, floor, lgamma, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

#: What is left out at each step is below exp(-SMALL) of what is kept.
SMALL = 42.0


def tail(spark: SparkSession, boards: list[tuple[int, int, int]], n: int, least: int) -> float | None:
    """Chance of at least ``least`` (> 0) matches among n rows, to 10 digits or more, or None where this way does not hold.

    boards: (a, b, times): so many labels that a rows predict and b rows expect. With r_k ways of k rooks on them, t to the
    number of matches has mean sum of r_k (t - 1)^k (n - k)! / n!, which is the integral of x^n e^-x / n! times the product
    of the boards' polynomials R((t - 1) / x). R is a Laguerre polynomial, so it is a product of 1 + z y over positive z: given
    x, matches are a sum of independent trials of chance z / x, wherever x is above all z. So everything is a chance, and
    nothing cancels. A task a set of boards evaluates R by its recurrence over a few x and t; the driver adds up their logarithms.

    Trials are weighed by ``rho`` a success, so that ``least`` is near their mean and small chances keep their digits. Rates
    of t on the circle are left out where the trials' variance makes them negligible, x where its weight is. Where labels
    hold so much that some z is near the likely x (about a seventh of many rows, a tenth of 1000), or more than a quarter of
    the rows should match, this returns None."""
    a, b, times = np.array([(min(x, y), max(x, y), c) for x, y, c in boards], "float64").reshape(-1, 3).T
    first, second = float((times * a * b).sum()), float((times * a * b * (a + b - 1)).sum())  # sums of z and of its squares
    most = int((times * a).sum())
    if least > most or _log_bound(a, b, times, n, least, first) < -746:  # below the least double
        return 0.0
    top = float((a + b - 2 + np.sqrt(1 + 4 * (a - 1) * (b - 1))).max())  # no z is above

    def mean(x: float, rho: float, c: np.ndarray) -> float:
        return rho / x * float((times * a * b / (1 + c * (rho - 1) / x)).sum())

    rho = _weight(a, b, times, n, least)
    marked = (1 - 1 / rho) * least
    if 4 * marked > n:
        return None
    span = 10.5 / sqrt(n - 2 * marked)
    low, high = (n - marked) * exp(-span), (n - marked) * exp(span)
    if low <= top:
        return None
    # The mean over all x lies between these two; Bernstein's inequality bounds what is further away.
    down, up = mean(high, rho, a + b - 1), mean(low, rho, b)
    far = SMALL / 3 + sqrt(SMALL * SMALL / 9 + 2 * SMALL * up)
    begin, end = max(floor(down - far), 0), min(ceil(up + far), most)
    size = (end - begin + 1) | 1
    variance = rho * min(first / x - second / x**2 for x in (low, high)) / (1 + top / low * (rho - 1)) ** 2
    rates = 2 * pi * np.arange(0, size // 2 + 1) / size
    rates = rates[variance * (1 - np.cos(rates)) <= SMALL]
    step = 2 * pi / (sqrt(2 * SMALL * n) + rates[-1] * up)
    from_n = log((n - marked) / n) + np.linspace(-span, span, ceil(2 * span / step) + 1)  # log(x / n)
    y = (rho * np.exp(1j * rates)[:, None] - 1) / (n * np.exp(from_n))
    y[0] = y[0].real

    slots = min(len(boards), 4 * spark.sparkContext.defaultParallelism)
    parts = spark.createDataFrame([(int(i), int(j), int(c)) for i, j, c in zip(a, b, times)], "a long, b long, times long").repartition(slots)
    size_of, angle = np.zeros(y.shape), np.zeros(y.shape)
    for r in parts.mapInPandas(_logarithms(y), "size array<double>, angle array<double>").collect():  # one a task
        size_of += np.reshape(r["size"], y.shape)
        angle += np.reshape(r["angle"], y.shape)

    # x^n e^-x / n! dx over log(x / n), by Stirling's series; the ends' weights are negligible, so the sum is the integral.
    weight = n * (from_n - np.expm1(from_n)) + from_n + 0.5 * log(n / (2 * pi)) - 1 / (12 * n) + 1 / (360 * n**3) + size_of[0]
    peak = weight.max()
    weight = np.exp(weight - peak)
    whole = 0.0 if rho == 1 else peak + log(weight.sum() * (from_n[1] - from_n[0]))
    if not _negligible(a, b, times, n, rho, top, whole - SMALL - 2 * log(n)):
        return None
    turned = (np.exp(size_of[1:] + 1j * angle[1:]) * weight).sum(axis=1) / weight.sum()
    j = np.arange(max(begin, least), end + 1)
    chance = np.full(len(j), 1.0)
    for rate, f in zip(rates[1:], turned):
        chance += 2 * (f * np.exp(-1j * rate * j)).real
    return float(min(max((chance / size * np.exp(whole - j * log(rho))).sum(), 0.0), 1.0))


def _logarithms(y: np.ndarray):
    """A task's sum of log R(y) over its boards: the first row's (real) as it is, of the others what they differ from it."""

    def run(parts):
        size, angle, square = np.zeros(y.shape), np.zeros(y.shape), y * y
        for part in parts:
            for a, b, times in part.itertuples(index=False):
                before, now, scale = np.zeros_like(y), np.ones_like(y), np.zeros(y.shape[1])
                for k in range(a):
                    before, now = now, (1 + (2 * k + 1 + b - a) * y) * now - (float(k) * (k + b - a)) * square * before
                    if k % 8 == 7 or k == a - 1:
                        first = now[0].real.copy()
                        before, now, scale = before / first, now / first, scale + np.log(first)
                with np.errstate(divide="ignore"):
                    size[1:] += times * np.log(np.abs(now[1:]))
                size[0] += times * scale
                angle += times * np.angle(now)
        yield pd.DataFrame({"size": [size.ravel()], "angle": [angle.ravel()]})

    return run


def _weight(a: np.ndarray, b: np.ndarray, times: np.ndarray, n: int, least: int) -> float:
    """The weight of a success at which about ``least`` matches are expected, at least 1; any value gives right results."""

    def mean(rho: float) -> float:
        x = n - (1 - 1 / rho) * least
        y = (rho - 1) / x
        c = 1 + (a + b) * y
        return rho / x * float((times * 2 * a * b / (c + np.sqrt(c * c - 4 * a * b * y * y))).sum())

    low, high = 0.0, log(1e12)
    if mean(1.0) >= least:
        return 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(exp(mid)) < least else (low, mid)
    return exp(low)


def _log_bound(a: np.ndarray, b: np.ndarray, times: np.ndarray, n: int, least: int, first: float) -> float:
    """An upper bound of the tail's logarithm: of C(matches, k), over C(least, k), with r_k <= R(y) / y^k for any y."""
    k = max(least - floor(first / n), 0)
    ways = lambda e: float((times * a * np.log1p(exp(e) * b)).sum()) - k * e
    low, high = -log(n) - 20.0, 20.0
    for _ in range(80):
        third = (high - low) / 3
        low, high = (low, high - third) if ways(low + third) < ways(high - third) else (low + third, high)
    return ways(low) + lgamma(n - k + 1) - lgamma(n + 1) - lgamma(least + 1) + lgamma(k + 1) + lgamma(least - k + 1)


def _negligible(a: np.ndarray, b: np.ndarray, times: np.ndarray, n: int, rho: float, top: float, level: float) -> bool:
    """Whether x below ``top``, where z / x is no chance, adds less than exp(level).

    With c = z / x a trial's factor is at most f = max(1, 2 c - 1) there. Of a board, log f is below 0.31 c^2, whose sum is known,
    and below a concave function, so below that of the mean c. Stretches of x are taken down to where all of the rest, as
    x^n times the product of 1 + (rho + 1) c grows with x, is below it too."""
    logs = lambda c, x: float((times * a * np.log1p(c * b / x)).sum())
    while n * log(top) + logs(rho + 1, top) - lgamma(n + 1) > level:
        under = 0.99 * top
        c = b / under
        bend = 1 / 0.557 + 0.5  # from here on the concave function is log f and a constant
        concave = 0.557 * np.minimum(c, bend) + np.log((2 * np.maximum(c, bend) - 1) / (2 * bend - 1))
        more = times * np.minimum(0.31 * a * b * (a + b - 1) / under**2, a * concave)
        if n * log(top) - under + float(more.sum()) + logs(rho - 1, under) - lgamma(n + 1) > level:
            return False
        top = under
    return True
