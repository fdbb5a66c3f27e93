"""Exact-count draws without replacement as Catalyst expressions.

``draw_hypergeometric`` inverts the distribution from its mode outwards, so its
cost follows the standard deviation and not the counts. ``draw_multivariate``
draws one coordinate after the other, each conditioned on those before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from snarewatch.llm.common import let, unit_interval

_SMALL = [math.lgamma(n + 1.0) for n in range(16)]


def log_factorial(n: Column) -> Column:
    """ln n! of a whole number >= 0: a short table, then Stirling's series."""
    x = F.greatest(n.cast("double"), F.lit(16.0))
    series = (
        x * F.ln(x) - x + F.lit(0.5) * F.ln(x * F.lit(2.0 * math.pi))
        + F.lit(1.0) / (x * F.lit(12.0))
        - F.lit(1.0) / (x * x * x * F.lit(360.0))
        + F.lit(1.0) / (x * x * x * x * x * F.lit(1260.0))
    )
    small = F.array(*[F.lit(v) for v in _SMALL])
    return F.when(n < 16, F.get(small, n.cast("int"))).otherwise(series)


def _log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def draw_hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` items taken from ``total``, ``good`` of them marked, are marked.

    ``u`` is uniform in [0, 1). All counts are bigint. Values are tried from the
    mode outwards, on both sides at once, until their probability exceeds ``u``;
    twelve standard deviations and sixteen more steps are enough for doubles.
    """

    def walk(s: Column) -> Column:
        lo, hi, mode = s["lo"], s["hi"], s["mode"]
        top = F.exp(_log_choose(good, mode) + _log_choose(total - good, draws - mode) - _log_choose(total, draws))
        share = good.cast("double") / F.greatest(total, F.lit(1))
        variance = draws * share * (F.lit(1.0) - share) * (total - draws) / F.greatest(total - 1, F.lit(1))
        steps = F.least(hi - lo, F.ceil(F.lit(12.0) * F.sqrt(F.greatest(variance, F.lit(0.0)))) + 16)

        def state(left, at_right, p_right, at_left, p_left, found):
            return F.struct(
                left.alias("left"), at_right.alias("xr"), p_right.alias("pr"),
                at_left.alias("xl"), p_left.alias("pl"), found.alias("found"),
            )

        def step(a: Column, _: Column) -> Column:
            xr, xl = a["xr"].cast("double"), a["xl"].cast("double")
            free = (total - good - draws).cast("double")
            pr = a["pr"] * (good - xr) * (draws - xr) / ((xr + 1) * (free + xr + 1))
            pl = a["pl"] * xl * (free + xl) / ((good - xl + 1) * (draws - xl + 1))

            def choose(p: Column) -> Column:
                found = (
                    F.when(a["found"] >= 0, a["found"])
                    .when(a["left"] < p["pr"], a["xr"] + 1)
                    .when(a["left"] < p["pr"] + p["pl"], a["xl"] - 1)
                    .otherwise(F.lit(-1).cast("bigint"))
                )
                return state(a["left"] - p["pr"] - p["pl"], a["xr"] + 1, p["pr"], a["xl"] - 1, p["pl"], found)

            return let(F.struct(F.greatest(pr, F.lit(0.0)).alias("pr"), F.greatest(pl, F.lit(0.0)).alias("pl")), choose)

        def begin(p: Column) -> Column:
            first = F.when(u < p, mode).otherwise(F.lit(-1).cast("bigint"))
            start = state(u - p, mode, p, mode, p, first)
            found = F.aggregate(
                F.when(steps > 0, F.sequence(F.lit(1).cast("bigint"), steps)).otherwise(F.array().cast("array<bigint>")),
                start, step, lambda a: a["found"],
            )
            return let(found, lambda x: F.when(x < 0, mode).otherwise(x))

        return let(top, begin)

    lo = F.greatest(F.lit(0).cast("bigint"), draws + good - total)
    hi = F.least(draws, good)
    centre = F.floor((draws + 1).cast("double") * (good + 1).cast("double") / (total + 2).cast("double"))
    bounds = F.struct(lo.alias("lo"), hi.alias("hi"), F.least(F.greatest(centre, lo), hi).alias("mode"))
    return let(bounds, lambda s: F.when(s["lo"] >= s["hi"], s["lo"]).otherwise(walk(s)))


def draw_multivariate(counts: Column, draws: Column, *seed: Column) -> Column:
    """Split ``draws`` over the cells of ``counts`` (array<bigint>) as an urn would.

    Every cell is at most its count and the cells sum to ``draws``, which must not
    exceed the sum of the counts. The same seed gives the same draw.
    """
    zero = F.lit(0).cast("bigint")
    start = F.struct(
        F.array().cast("array<bigint>").alias("out"),
        draws.cast("bigint").alias("left"),
        F.aggregate(counts, zero, lambda a, x: a + x).alias("total"),
    )

    def cell(a: Column, good: Column) -> Column:
        u = unit_interval(*seed, F.size(a["out"]))
        x = draw_hypergeometric(a["total"], good, a["left"], u)
        return let(
            x,
            lambda v: F.struct(
                F.concat(a["out"], F.array(v)).alias("out"), (a["left"] - v).alias("left"), (a["total"] - good).alias("total")
            ),
        )

    return F.aggregate(counts, start, cell, lambda a: a["out"])
