"""Exact random counts and index permutations as column expressions.

A count is drawn by inverting its distribution function. The probabilities around the mode follow
from the ratio of neighbours, so no factorials are needed. Values further than ``REACH`` standard
deviations (plus ``MARGIN``) from the mean have a joint probability below the resolution of the
uniform number that is inverted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.llm.common import let, uniform

REACH, MARGIN = 9, 14


def _invert(low: Column, high: Column, ratio: Callable[[Column], Column], u: Column) -> Column:
    """The value in [low, high] at which the running weight passes the share ``u`` of its total.

    ``ratio(k)`` is weight(k + 1) / weight(k); the weight of ``low`` counts as 1.
    """
    steps = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
    one = F.lit(1.0)

    def add(state, k):
        return let(state["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (state["sum"] + w).alias("sum")))

    def onward(state, k):
        return let(state["w"] * ratio(k), lambda w: F.struct(
            w.alias("w"), (state["sum"] + w).alias("sum"), (k + 1).alias("at")))

    def search(steps):
        total = F.aggregate(steps, F.struct(one.alias("w"), one.alias("sum")), add, lambda s: s["sum"])
        start = F.struct(one.alias("w"), one.alias("sum"), low.alias("at"))
        return let(total * u, lambda goal: F.aggregate(
            steps, start, lambda s, k: F.when(s["sum"] > goal, s).otherwise(onward(s, k)), lambda s: s["at"]))

    return let(steps, search)


def _bounded(mean: Column, variance: Column, low: Column, high: Column, ratio: Callable[[Column], Column], u: Column) -> Column:
    """Invert over the values of [low, high] that are within reach of the mean."""
    def around(m):
        reach = F.sqrt(F.greatest(variance, F.lit(0.0))) * REACH + MARGIN
        return let(reach, lambda r: F.struct(
            F.greatest(low, F.floor(m - r).cast("long")).alias("a"), F.least(high, F.ceil(m + r).cast("long")).alias("b")))

    return let(let(mean, around), lambda s: _invert(s["a"], s["b"], ratio, u))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` items are among the ``marked`` ones of ``total``."""
    sizes = F.struct(
        F.greatest(total, F.lit(1)).cast("double").alias("n"), marked.cast("double").alias("k"),
        drawn.cast("double").alias("d"), (total - marked - drawn).cast("double").alias("rest"))

    def draw(x):
        mean = x["d"] * x["k"] / x["n"]
        variance = mean * (1 - x["k"] / x["n"]) * (x["n"] - x["d"]) / F.greatest(x["n"] - 1, F.lit(1.0))
        low = F.greatest(F.lit(0.0), -x["rest"]).cast("long")
        high = F.least(x["k"], x["d"]).cast("long")
        return _bounded(mean, variance, low, high, lambda k: (x["k"] - k) * (x["d"] - k) / ((k + 1) * (x["rest"] + k + 1)), u)

    return let(sizes, draw)


def binomial(n: Column, p: Column, u: Column) -> Column:
    """Successes in ``n`` trials of chance ``p``; ``p`` from 1 on gives ``n``."""
    def draw(x):
        mean = x["n"] * x["p"]
        return _bounded(mean, mean * (1 - x["p"]), F.lit(0).cast("long"), x["n"].cast("long"),
                        lambda k: (x["n"] - k) / (k + 1) * x["odds"], u)

    terms = F.struct(n.cast("double").alias("n"), p.alias("p"), (p / (1 - p)).alias("odds"))
    return F.when(p >= 1, n).when(p <= 0, F.lit(0).cast("long")).otherwise(let(terms, draw))


def summed(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def split_counts(need: Column, stock: Column, seed: int, *where: Column) -> Column:
    """Draw ``need`` items without replacement from piles of the sizes in ``stock``: one count per pile."""
    start = F.struct(need.alias("need"), summed(stock).alias("left"), F.array().cast("array<bigint>").alias("out"))

    def pile(s, i):
        here = F.get(stock, i)
        count = hypergeometric(s["left"], here, s["need"], uniform(seed, *where, i))
        return let(count, lambda c: F.struct(
            (s["need"] - c).alias("need"), (s["left"] - here).alias("left"), F.concat(s["out"], F.array(c)).alias("out")))

    return F.aggregate(F.sequence(F.lit(0), F.size(stock) - 1), start, pile, lambda s: s["out"])


def multinomial(n: Column, weights: Column, seed: int, *where: Column) -> Column:
    """Counts of ``n`` independent draws from categories with these whole-number weights."""
    start = F.struct(n.alias("need"), summed(weights).alias("left"), F.array().cast("array<bigint>").alias("out"))

    def category(s, i):
        here = F.get(weights, i)
        share = F.when(s["left"] > 0, here.cast("double") / s["left"]).otherwise(F.lit(0.0))
        count = let(share, lambda p: binomial(s["need"], p, uniform(seed, *where, i)))
        return let(count, lambda c: F.struct(
            (s["need"] - c).alias("need"), (s["left"] - here).alias("left"), F.concat(s["out"], F.array(c)).alias("out")))

    return F.aggregate(F.sequence(F.lit(0), F.size(weights) - 1), start, category, lambda s: s["out"])


def mirror_points(size: Column, rounds: int, seed: int, *key: Column) -> Column:
    """The keyed points, one per round, around which ``permuted`` mirrors."""
    return F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: F.pmod(F.xxhash64(F.lit(seed), *key, r), size))


def permuted(index: Column, size: Column, points: Column, *key: Column) -> Column:
    """The place of ``index`` in a keyed pseudorandom permutation of 0 .. size - 1 (swap-or-not shuffle).

    In each round an index and its mirror image around a point are swapped or not, as one keyed bit
    of the larger says. Every round is its own inverse, so any ``size`` gives a bijection.
    """
    def turn(x, point):
        mirror = F.pmod(point - x, size)
        swap = F.xxhash64(point, *key, F.greatest(x, mirror)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(points, index, turn)
