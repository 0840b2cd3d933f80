"""Gamma and beta functions as SQL expressions, evaluated by Spark without Python.

Arguments and results are SQL text (a column name, a literal, an expression); ``F.expr`` makes a
column of it. Text is parsed in one go, where the same trees of column objects take seconds to build.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from statistics import NormalDist

_SHIFT = 10
_TINY = "1e-300D"
_NAMES = itertools.count()


def number(value: float) -> str:
    """A double literal."""
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def bound(value: str, use: Callable[[str], str]) -> str:
    """``use(value)`` with ``value`` evaluated once: as the element of a one-element array."""
    name = f"v{next(_NAMES)}"
    return f"element_at(transform(array({value}), {name} -> {use(name)}), 1)"


def folded(steps: str, start: str, step: Callable[[str, str], str]) -> str:
    """``start`` after ``step(state, i)`` for i = 1 to ``steps``."""
    state, i = f"s{next(_NAMES)}", f"i{next(_NAMES)}"
    return f"aggregate(sequence(1, CAST({steps} AS INT)), {start}, ({state}, {i}) -> {step(state, i)})"


def log_gamma(x: str) -> str:
    """Logarithm of the gamma function for x > 0, to about 1e-12.

    Stirling's series behind ``_SHIFT`` steps of the recurrence.
    """

    def series(z: str) -> str:
        terms = f"1D/12/{z} - 1D/360/pow({z}, 3) + 1D/1260/pow({z}, 5) - 1D/1680/pow({z}, 7)"
        return f"(({z} - 0.5D) * ln({z}) - {z} + {number(0.5 * math.log(2 * math.pi))} + {terms})"

    def both(v: str) -> str:
        # Without a branch: the product is 1 where no step is needed.
        product = " * ".join(f"({v} + {i})" for i in range(_SHIFT))
        moved = bound(f"IF({v} < {_SHIFT}, {v} + {_SHIFT}, {v})", series)
        return f"({moved} - IF({v} < {_SHIFT}, ln({product}), 0D))"

    return bound(f"CAST({x} AS DOUBLE)", both)


def log_beta(a: str, b: str) -> str:
    return f"({log_gamma(a)} + {log_gamma(b)} - {log_gamma(f'({a} + {b})')})"


def digamma_step(x: str, m: str) -> str:
    """digamma(x + m) - digamma(x) for x > 0, m >= 0, without cancellation for large x."""

    def far(z: str) -> str:
        # Differences of the asymptotic series' terms; the leading ones are subtracted as products.
        w = f"({z} + {m})"
        square = f"{m} * ({z} + {w}) / ({z} * {z} * {w} * {w})"
        fourth = f"{square} * (1D/({z} * {z}) + 1D/({w} * {w}))"
        return f"log1p({m} / {z}) + {m} / ({z} * {w}) / 2 + {square} / 12 - {fourth} / 120 + (pow({z}, -6) - pow({w}, -6)) / 252"

    def near(z: str) -> str:
        steps = folded(str(_SHIFT), "0D", lambda s, i: f"{s} + {m} / (({z} + {i} - 1) * ({z} + {m} + {i} - 1))")
        return f"({steps} + {bound(f'({z} + {_SHIFT})', far)})"

    return bound(f"CAST({x} AS DOUBLE)", near)


def trigamma_step(x: str, m: str) -> str:
    """trigamma(x + m) - trigamma(x) for x > 0, m >= 0; never positive."""

    def far(z: str) -> str:
        w = f"({z} + {m})"
        square = f"{m} * ({z} + {w}) / ({z} * {z} * {w} * {w})"
        odd = " ".join(f"{sign} (pow({z}, -{p}) - pow({w}, -{p})) / {c}" for sign, p, c in (("+", 3, 6), ("-", 5, 30), ("+", 7, 42)))
        return f"({m} / ({z} * {w}) + {square} / 2 {odd})"

    def near(z: str) -> str:
        term = lambda i: f"{m} * (2 * {z} + {m} + 2 * ({i} - 1)) / pow(({z} + {i} - 1) * ({z} + {m} + {i} - 1), 2)"
        steps = folded(str(_SHIFT), "0D", lambda s, i: f"{s} + {term(i)}")
        return f"(-({steps}) - {bound(f'({z} + {_SHIFT})', far)})"

    return bound(f"CAST({x} AS DOUBLE)", near)


def _fraction(a: str, b: str, x: str) -> str:
    """The continued fraction of the incomplete beta function, from the front (Lentz's method).

    The number of half steps grows with the root of the larger parameter.
    """
    safe = lambda value: bound(value, lambda v: f"IF(abs({v}) < {_TINY}, {_TINY}, {v})")

    def half_step(state: str, i: str) -> str:
        m = f"({i} div 2)"
        even = f"{m} * ({b} - {m}) * {x} / (({a} + 2 * {m} - 1) * ({a} + 2 * {m}))"
        odd = f"-({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + 2 * {m}) * ({a} + 2 * {m} + 1))"

        def moved(t: str) -> str:
            pair = f"struct({safe(f'(1 + {t} / {state}.c)')} AS c, 1 / {safe(f'(1 + {t} * {state}.d)')} AS d)"
            return bound(pair, lambda p: f"struct({p}.c AS c, {p}.d AS d, {state}.h * {p}.c * {p}.d AS h)")

        return bound(f"IF({i} % 2 = 0, {even}, {odd})", moved)

    # Before the first half step the numerator is without bound, so its own ratio is 1 there.
    start = f"struct({number(math.inf)} AS c, 1D AS d, 1D AS h)"
    return f"{folded(f'50 + 4 * sqrt(greatest({a}, {b}))', start, half_step)}.h"


def incomplete_beta(x: str, a: str, b: str) -> str:
    """The regularised incomplete beta function I_x(a, b) for a, b > 0: the distribution function of Beta(a, b)."""

    def inside(v: str) -> str:
        front = f"exp({v}.a * ln({v}.x) + {v}.b * ln(1 - {v}.x) - {log_beta(f'{v}.a', f'{v}.b')})"
        return bound(f"{front} * {_fraction(f'{v}.a', f'{v}.b', f'{v}.x')} / {v}.a", lambda p: f"IF({v}.flip, 1 - {p}, {p})")

    def turned(v: str) -> str:
        # The fraction converges fast below the mean; beyond it the other tail is taken.
        flip = f"{v}.x >= ({v}.a + 1) / ({v}.a + {v}.b + 2)"
        pick = lambda f: f"struct(IF({f}, {v}.b, {v}.a) AS a, IF({f}, {v}.a, {v}.b) AS b, IF({f}, 1 - {v}.x, {v}.x) AS x, {f} AS flip)"
        return f"CASE WHEN {v}.x <= 0 THEN 0D WHEN {v}.x >= 1 THEN 1D ELSE {bound(bound(flip, pick), inside)} END"

    return bound(f"struct(CAST({x} AS DOUBLE) AS x, CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b)", turned)


def beta_quantile(p: float, a: str, b: str, steps: int = 60) -> str:
    """The ``p`` quantile of Beta(a, b), by Newton steps inside a shrinking bracket.

    They start at the normal approximation where it holds (both parameters above 1), else at the mean,
    and end where the distribution function is off by 1e-11 at most: usually after three of them.
    """
    z = -NormalDist().inv_cdf(p)

    def first(v: str) -> str:
        one, two = f"(1D / (2 * {v}.a - 1))", f"(1D / (2 * {v}.b - 1))"
        lift, h = number((z * z - 3) / 6), f"(2D / ({one} + {two}))"
        w = f"({number(z)} * sqrt(greatest({h} + {lift}, 0D)) / {h} - ({two} - {one}) * ({lift} + 5D/6 - 2D/3/{h}))"
        near = bound(f"{v}.a / ({v}.a + {v}.b * exp(2 * {w}))", lambda n: f"IF({n} > 0 AND {n} < 1, {n}, {v}.a / ({v}.a + {v}.b))")
        return f"IF({v}.a > 1 AND {v}.b > 1, {near}, {v}.a / ({v}.a + {v}.b))"

    def solved(v: str) -> str:
        def step(state: str, _: str) -> str:
            x = f"{state}.x"
            density = f"exp(({v}.a - 1) * ln({x}) + ({v}.b - 1) * ln(1 - {x}) - {v}.beta)"

            def moved(gap: str) -> str:
                kept = (
                    f"struct(IF({gap} < 0, {x}, {state}.low) AS low, IF({gap} < 0, {state}.high, {x}) AS high, "
                    f"{x} - {gap} / greatest({density}, {_TINY}) AS x, abs({gap}) < 1e-11D AS done)"
                )
                return bound(
                    kept,
                    lambda s: f"struct({s}.low AS low, {s}.high AS high, "
                    f"IF({s}.done OR {s}.x > {s}.low AND {s}.x < {s}.high, {s}.x, ({s}.low + {s}.high) / 2) AS x, {s}.done AS done)",
                )

            gap = f"{incomplete_beta(x, f'{v}.a', f'{v}.b')} - {number(p)}"
            return f"IF({state}.done, {state}, {bound(gap, moved)})"

        return f"{folded(str(steps), f'struct(0D AS low, 1D AS high, {first(v)} AS x, false AS done)', step)}.x"

    with_beta = lambda v: bound(f"struct({v}.a AS a, {v}.b AS b, {log_beta(f'{v}.a', f'{v}.b')} AS beta)", solved)
    return bound(f"struct(CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b)", with_beta)


def binomial_at_least(k: str, n: str, p: str) -> str:
    """P(X >= k) of a binomial variable, exactly."""
    return f"CASE WHEN {k} <= 0 THEN 1D WHEN {k} > {n} THEN 0D ELSE {incomplete_beta(p, k, f'({n} - {k} + 1)')} END"


def binomial_at_most(k: str, n: str, p: str) -> str:
    """P(X <= k) of a binomial variable, exactly: the chance of at least n - k failures."""
    return f"CASE WHEN {k} < 0 THEN 0D WHEN {k} >= {n} THEN 1D ELSE {incomplete_beta(f'(1 - {p})', f'({n} - {k})', f'({k} + 1)')} END"
