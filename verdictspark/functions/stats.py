"""Statistical functions as Column expressions, and the same as portable SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rational approximation AS241 of the normal quantile (Wichura 1988).
CENTRE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
NEAR = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0),
)
FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)


def _horner(coefficients: tuple[float, ...], r: str) -> str:
    text = f"{coefficients[0]:e}" if coefficients[0] == 1 else _number(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {r} + {_number(c)})"
    return text


def _number(x: float) -> str:
    """A literal that both SQL dialects read as a double."""
    text = repr(x)
    return text if "e" in text else f"{text}e0"


def probit_sql(p: str) -> str:
    """The normal quantile of a probability column, as SQL text."""
    q = f"({p} - 0.5e0)"
    c = f"(0.180625e0 - {q} * {q})"
    tail = f"sqrt(-ln(least({p}, 1e0 - {p})))"
    near, far = f"({tail} - 1.6e0)", f"({tail} - 5e0)"
    ratio = lambda pair, r: f"{_horner(pair[0], r)} / {_horner(pair[1], r)}"
    sign = f"CASE WHEN {q} < 0e0 THEN -1e0 ELSE 1e0 END"
    return (
        f"CASE WHEN abs({q}) <= 0.425e0 THEN {q} * {ratio(CENTRE, c)} "
        f"WHEN {tail} <= 5e0 THEN {sign} * ({ratio(NEAR, near)}) ELSE {sign} * ({ratio(FAR, far)}) END"
    )


def probit(column: str) -> Column:
    return F.expr(probit_sql(column))


def smoothed_rate_sql(rate: str, n: str) -> str:
    """The log-linear correction of a rate over n items, which keeps it off 0 and 1."""
    return f"(({rate} * {n} + 0.5e0) / ({n} + 1e0))"


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Rounded to `digits`, without negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(c.cast("double"), digits) + F.lit(0.0)).cast("double")


def normal_cdf_sql(z: str) -> str:
    """Phi by Abramowitz and Stegun 26.2.17 (error below 7.5e-8), portable SQL."""
    t = f"(1e0 / (1e0 + 0.2316419e0 * abs({z})))"
    poly = f"{t} * (0.319381530e0 + {t} * (-0.356563782e0 + {t} * (1.781477937e0 + {t} * (-1.821255978e0 + {t} * 1.330274429e0))))"
    upper = f"(0.3989422804014327e0 * exp(-{z} * {z} / 2e0) * ({poly}))"
    return f"CASE WHEN {z} >= 0e0 THEN 1e0 - {upper} ELSE {upper} END"


def paired_p(z: str) -> Column:
    """The two-sided p of a z column; 1 where z is null (no spread)."""
    return F.coalesce(F.expr(f"2e0 * (1e0 - ({normal_cdf_sql(f'abs({z})')}))"), F.lit(1.0))
