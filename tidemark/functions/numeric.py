"""Numbers, vectors and probability as Column expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def argmax(values: Column) -> Column:
    """Position from 0 of the first largest value."""
    return F.array_position(values, F.array_max(values)) - 1


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def decay(hours: Column, half_life: float | Column) -> Column:
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), hours) / half_life)


def severity_multiplier(impact: Column) -> Column:
    return clip((impact - 4.0) / 4.5, 0.25, 1.35)


# Coefficients of Wichura's algorithm AS 241 for the normal quantile, centre and two tails.
_CENTRE = ([3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727], [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610])
_TAIL = ([1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4], [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9])
_FAR = ([6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7], [1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15])


def _horner(c: list[float], x: str) -> str:
    out = repr(c[-1])
    for a in reversed(c[:-1]):
        out = f"({out} * {x} + {a!r})"
    return out


def _ratio(pair: tuple[list[float], list[float]], x: str) -> str:
    return f"({_horner(pair[0], x)} / {_horner(pair[1], x)})"


def normal_quantile_sql(p: str) -> str:
    """The normal quantile as SQL text that Spark and others read alike."""
    q = f"({p} - 0.5e0)"
    r = f"sqrt(-ln(least({p}, 1e0 - ({p}))))"
    centre = f"{q} * {_ratio(_CENTRE, f'(0.180625e0 - {q} * {q})')}"
    tails = f"sign({q}) * CASE WHEN {r} <= 5e0 THEN {_ratio(_TAIL, f'({r} - 1.6e0)')} ELSE {_ratio(_FAR, f'({r} - 5e0)')} END"
    return f"(CASE WHEN abs({q}) <= 0.425e0 THEN {centre} ELSE {tails} END)"


# Hart's rational approximation of the normal distribution function, as given by West (2005).
_HART = ([220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 0.0352624965998911], [440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 0.0883883476483184])


def normal_cdf_sql(x: str) -> str:
    """The normal distribution function as SQL text, to about 1e-15."""
    a = f"abs({x})"
    near = f"exp(-{a} * {a} / 2e0) * {_ratio(_HART, a)}"
    far = f"exp(-{a} * {a} / 2e0) / ({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / ({a} + 4e0 / ({a} + 0.65e0))))) / 2.506628274631e0"
    tail = f"(CASE WHEN {a} > 37e0 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1e0 - {tail} ELSE {tail} END)"


Steps = list[tuple[str, str]]


def normal_quantile_steps(p: str, out: str) -> Steps:
    """The same as ``normal_quantile_sql`` in columns, so that nothing is worked out twice."""
    q, r, c, s, t = (f"{out}_{n}" for n in "qrcst")
    return [(q, f"{p} - 0.5e0"), (r, f"sqrt(-ln(least({p}, 1e0 - {p})))"), (c, f"0.180625e0 - {q} * {q}"), (s, f"{r} - 1.6e0"), (t, f"{r} - 5e0"), (out, f"CASE WHEN abs({q}) <= 0.425e0 THEN {q} * {_ratio(_CENTRE, c)} WHEN {r} <= 5e0 THEN sign({q}) * {_ratio(_TAIL, s)} ELSE sign({q}) * {_ratio(_FAR, t)} END")]


def normal_cdf_steps(x: str, out: str) -> Steps:
    a, e, tail = (f"{out}_{n}" for n in ("a", "e", "tail"))
    far = f"{e} / ({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / ({a} + 4e0 / ({a} + 0.65e0))))) / 2.506628274631e0"
    return [(a, f"abs({x})"), (e, f"exp(-{a} * {a} / 2e0)"), (tail, f"CASE WHEN {a} > 37e0 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN {e} * {_ratio(_HART, a)} ELSE {far} END"), (out, f"CASE WHEN {x} > 0 THEN 1e0 - {tail} ELSE {tail} END")]


# Rating grades from best to worst with one-year default probabilities, the Basel floor, and standardised weights.
RATING_PD = {"AAA": 0.0001, "AA": 0.0002, "A": 0.0006, "BBB": 0.0020, "BB": 0.0090, "B": 0.0350, "CCC": 0.2000, "D": 1.0}
STANDARD_WEIGHT = {"AAA": 0.2, "AA": 0.2, "A": 0.5, "BBB": 1.0, "BB": 1.0, "B": 1.5, "CCC": 1.5, "D": 1.5}
GRADES = list(RATING_PD)
PD_FLOOR = 0.0003


def case_sql(column: str, values: dict[str, float], otherwise: str = "NULL") -> str:
    """A look-up in a few fixed values."""
    return f"(CASE {column} " + " ".join(f"WHEN '{k}' THEN CAST({v!r} AS DOUBLE)" for k, v in values.items()) + f" ELSE {otherwise} END)"


def correlation_sql(pd: str) -> str:
    """Basel asset correlation, from 24% for the safest to 12%."""
    w = f"((1e0 - exp(-50e0 * {pd})) / (1e0 - exp(-50e0)))"
    return f"(0.12e0 * {w} + 0.24e0 * (1e0 - {w}))"


def stressed_pd_steps(pd: str, z: str, out: str) -> Steps:
    """Default probability after a systematic shock of z deviations: its probit moves by -z * sqrt(rho / (1 - rho))."""
    p, rho, probit, x = (f"{out}_{n}" for n in ("p", "rho", "probit", "x"))
    return [(p, f"greatest(1e-6, least(1e0 - 1e-9, {pd}))"), (rho, correlation_sql(p)), *normal_quantile_steps(p, probit), (x, f"({probit} - ({z}) * sqrt({rho} / (1e0 - {rho})))"), *normal_cdf_steps(x, out)]


def irb_weight_steps(pd: str, lgd: str, maturity: str, out: str) -> Steps:
    """Basel IRB risk weight of a corporate exposure, as a share of it."""
    p, rho, b, probit, x, n = (f"{out}_{n}" for n in ("p", "rho", "b", "probit", "x", "n"))
    m = f"greatest(1e0, least(5e0, {maturity}))"
    k = f"({lgd} * {n} - {p} * {lgd}) * (1e0 + ({m} - 2.5e0) * {b}) / (1e0 - 1.5e0 * {b})"
    return [
        (p, f"greatest({PD_FLOOR}e0, least(0.9999e0, {pd}))"),
        (rho, correlation_sql(p)),
        (b, f"pow(0.11852e0 - 0.05478e0 * ln({p}), 2)"),
        *normal_quantile_steps(p, probit),
        (x, f"(({probit} + sqrt({rho}) * 3.090232306167813e0) / sqrt(1e0 - {rho}))"),
        *normal_cdf_steps(x, n),
        (out, f"(greatest(0e0, {k}) * 12.5e0)"),
    ]


def with_steps(df: DataFrame, steps: Steps) -> DataFrame:
    """Columns added level by level: each is computed once, together with all whose inputs are there as well."""
    depth: dict[str, int] = {}
    levels: list[dict[str, Column]] = []
    for name, text in steps:
        depth[name] = max((depth[w] + 1 for w in set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text)) if w in depth), default=0)
        if depth[name] == len(levels):
            levels.append({})
        levels[depth[name]][name] = F.expr(text)
    for level in levels:
        df = df.withColumns(level)
    return df


def steps_sql(source: str, steps: Steps) -> str:
    """The same as nested SELECTs."""
    for name, text in steps:
        source = f"SELECT *, {text} AS {name} FROM ({source})"
    return source


def lifetime_pd_sql(pd: str, years: str) -> str:
    return f"(1e0 - pow(1e0 - greatest(0e0, least(1e0, {pd})), greatest(1e0, {years})))"


def nearest_grade_sql(pd: str) -> str:
    """The grade whose default probability is nearest on a log scale; D from 0.999 on."""
    grades = [g for g in GRADES if g != "D"]
    cuts = [(g, (RATING_PD[g] * RATING_PD[h]) ** 0.5) for g, h in zip(grades, grades[1:], strict=False)]
    return f"(CASE WHEN {pd} >= 0.999 THEN 'D' " + " ".join(f"WHEN {pd} <= {c!r} THEN '{g}'" for g, c in cuts) + f" ELSE '{grades[-1]}' END)"


def bond_duration(coupon: Column, yield_: Column, years: Column) -> Column:
    """A struct (duration, convexity): modified duration and convexity of a bond that pays once a year, the first time after a broken year if there is one."""
    periods = F.greatest(F.ceil(years), F.lit(1)).cast("int")
    times = F.transform(F.sequence(F.lit(1), periods), lambda k: years - periods + k)
    flow = lambda t: F.when(t >= years - 1e-9, coupon + 1.0).otherwise(coupon) * F.pow(1 + yield_, -t)
    add = lambda f: F.aggregate(times, F.lit(0.0), lambda s, t: s + f(t))
    price = add(flow)
    return F.struct((add(lambda t: t * flow(t)) / price / (1 + yield_)).alias("duration"), (add(lambda t: t * (t + 1) * flow(t)) / price / F.pow(1 + yield_, 2)).alias("convexity"))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0, to some 14 digits: Stirling's series eight steps up, and back down by the recurrence."""
    up = x + 8
    # The first terms of Stirling's series, Bernoulli numbers over 2k(2k - 1).
    terms = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156]
    series = sum((F.lit(c) / F.pow(up, F.lit(2.0 * i + 1)) for i, c in enumerate(terms)), F.lit(0.0))
    steps = sum((F.log(x + i) for i in range(1, 8)), F.log(x))
    return (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + series - steps


def incomplete_beta(x: Column, a: Column, b: Column, depth: int = 400) -> Column:
    """The regularised incomplete beta function, by its continued fraction from the far end; the root of the larger of a and b should stay below depth."""

    def part(p: Column) -> Column:
        u, v, w = p["x"], p["a"], p["b"]

        def step(f: Column, m: Column) -> Column:
            k = F.floor(m / 2)
            odd = -(v + k) * (v + w + k) * u / ((v + 2 * k) * (v + 2 * k + 1))
            even = k * (w - k) * u / ((v + 2 * k - 1) * (v + 2 * k))
            return 1 + F.when(m % 2 == 1, odd).otherwise(even) / f

        fraction = F.aggregate(F.sequence(F.lit(depth), F.lit(1), F.lit(-1)), F.lit(1.0), step)
        front = F.exp(v * F.log(u) + w * F.log(1 - u) - (log_gamma(v) + log_gamma(w) - log_gamma(v + w)))
        return front / (v * fraction)

    # The fraction converges fast to the left of the mean; the other side is its mirror image.
    mirrored = x > (a + 1) / (a + b + 2)
    side = F.struct(F.when(mirrored, 1 - x).otherwise(x).alias("x"), F.when(mirrored, b).otherwise(a).alias("a"), F.when(mirrored, a).otherwise(b).alias("b"))
    inner = F.element_at(F.transform(F.array(side), part), 1)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.when(mirrored, 1 - inner).otherwise(inner))


def t_tails(t: Column, df: Column) -> Column:
    """The probability that a Student-t variable is at least as far from 0 as t; null without a degree of freedom."""
    t, df = t.cast("double"), df.cast("double")
    return F.when(df > 0, F.when(F.isnan(t), F.lit(None)).otherwise(incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5))))


def rank_tails(rho: Column, n: Column) -> Column:
    """The two-sided p-value of a rank correlation of n pairs, by the t approximation."""
    return F.when(n > 2, incomplete_beta(1 - rho * rho, (n - 2) / 2.0, F.lit(0.5)))


def beta_sql(x: str, a: str, b: str, depth: int = 400) -> str:
    """``incomplete_beta`` as DuckDB SQL, over the library's own gamma function."""

    def part(x: str, a: str, b: str) -> str:
        step = f"1 + CASE WHEN m % 2 = 1 THEN -({a} + floor(m / 2)) * ({a} + {b} + floor(m / 2)) * {x} / (({a} + m - 1) * ({a} + m)) ELSE (m / 2) * ({b} - m / 2) * {x} / (({a} + m - 1) * ({a} + m)) END / f"
        return f"(exp({a} * ln({x}) + {b} * ln(1 - {x}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b})) / ({a} * list_reduce(list_prepend(1e0, list_transform(range({depth}, 0, -1), lambda i: i::DOUBLE)), lambda f, m: {step})))"

    mirror = part(f"(1 - {x})", b, a)
    return f"(CASE WHEN {x} <= 0 THEN 0e0 WHEN {x} >= 1 THEN 1e0 WHEN {x} > ({a} + 1) / ({a} + {b} + 2) THEN 1 - {mirror} ELSE {part(x, a, b)} END)"
