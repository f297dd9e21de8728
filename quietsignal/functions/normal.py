"""The normal distribution as column expressions: quantiles and upper tails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients, constant term first, of the published rational approximations AS 241 (quantile, 16 digits) by
# numerator and denominator: for |p - 1/2| <= 0.425, and for tails r = sqrt(-log(p)) up to 5 and beyond.
CENTRE = (
    [3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727],
    [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610],
)
TAIL = (
    [1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
)
FAR_TAIL = (
    [6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
)
#: The published Chebyshev fit of the complementary error function (relative error below 1.2e-7), in powers of t.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def polynomial(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def _ratio(pair: tuple[list[float], list[float]], x: Column) -> Column:
    return polynomial(pair[0], x) / polynomial(pair[1], x)


def quantile(p: Column) -> Column:
    """The standard normal quantile of ``p``; null outside of (0, 1)."""
    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.signum(q) * F.when(r <= 5, _ratio(TAIL, r - 1.6)).otherwise(_ratio(FAR_TAIL, r - 5))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * _ratio(CENTRE, 0.180625 - q * q)).otherwise(tail))


def upper_tail(z: Column) -> Column:
    """The probability that a standard normal number is above ``z``."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + x / 2)
    half = t * F.exp(-x * x + polynomial(ERFC, t)) / 2
    return F.when(z >= 0, half).otherwise(1 - half)
