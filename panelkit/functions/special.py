"""Special functions as column expressions: gamma and its derivatives, the gamma distribution, the normal quantile."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Asymptotic series are used from x + SHIFT on, and carried down by recurrence.
SHIFT = 10


def _powers(r: Column, coefficients: tuple[float, ...]) -> Column:
    """coefficients[0] + coefficients[1] * r + ... by Horner's rule."""
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = out * r + F.lit(c)
    return out


def digamma(x: Column) -> Column:
    """The derivative of log gamma, for x > 0."""
    y = x + SHIFT
    tail = _powers(1 / (y * y), (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132)) / (y * y)
    return F.log(y) - 0.5 / y - tail - sum((1 / (x + i) for i in range(SHIFT)), F.lit(0.0))


def trigamma(x: Column) -> Column:
    """The second derivative of log gamma, for x > 0."""
    y = x + SHIFT
    tail = _powers(1 / (y * y), (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66)) / (y * y * y)
    return 1 / y + 0.5 / (y * y) + tail + sum((1 / ((x + i) * (x + i)) for i in range(SHIFT)), F.lit(0.0))


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function, for x > 0."""
    y = x + SHIFT
    tail = _powers(1 / (y * y), (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)) / y
    product = x
    for i in range(1, SHIFT):
        product = product * (x + i)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + tail - F.log(product)


def gamma_shape(log_mean_less_mean_log: Column, steps: int = 12) -> Column:
    """The gamma distribution's shape of greatest likelihood, from log(mean) - mean(log), by Newton's method.

    Values that are all equal have no finite shape: theirs is 1e6. The first guess is within 2 %, so that a few steps reach double
    precision; a step that would leave the positive numbers halves the shape instead.
    """
    s = log_mean_less_mean_log
    start = (3 - s + F.sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s)

    def newton(k: Column) -> Column:
        step = (F.log(k) - digamma(k) - s) / (1 / k - trigamma(k))
        return F.when(k > step, k - step).otherwise(k / 2)

    return F.when(s <= 1e-12, F.lit(1e6)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda k, _: newton(k)))


def gamma_p(a: Column, x: Column) -> Column:
    """The regularised lower incomplete gamma function by its series, whose terms are all positive.

    The terms rise while their number is below x - a and then fall like a normal density of variance x: how many are
    needed follows from a and x. Far above a, where the rest is below double precision, it is 1.
    """
    terms = F.ceil(F.greatest(x - a, F.lit(0.0)) + 10 * F.sqrt(F.greatest(x, a)) + 40).cast("int")
    first = F.struct((1 / a).alias("term"), (1 / a).alias("total"))

    def add(state: Column, n: Column) -> Column:
        term = state["term"] * x / (a + n)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), terms), first, add, lambda state: state["total"])
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    beyond = x > a + 100 + 12 * F.sqrt(a)
    return F.when(x <= 0, F.lit(0.0)).when(beyond, F.lit(1.0)).otherwise(F.least(F.lit(1.0), front * total))


# The coefficients of Wichura's published algorithm AS 241 (PPND16), lowest power first.
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def normal_quantile(p: Column) -> Column:
    """The standard normal distribution's quantile, for 0 < p < 1, to double precision."""
    q = p - 0.5
    ratio = lambda r, table: _powers(r, table[0]) / _powers(r, table[1])
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(r <= 5, ratio(r - 1.6, MIDDLE)).otherwise(ratio(r - 5, FAR))
    return F.when(F.abs(q) <= 0.425, q * ratio(0.180625 - q * q, CENTRE)).otherwise(F.signum(q) * tail)
