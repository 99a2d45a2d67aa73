"""Tables of Chinese restaurants: how many the customers of each dish sit at, drawn by Gibbs sweeps.

Given the probability that the parent restaurant gives a dish, the number of tables t at
which its c customers sit has the weights a**t * S(c, t): S are the generalised Stirling numbers
of the discount, a is the weight of a new table. Draws take their chance numbers from
the names of restaurant and dish and the number of the sweep, so that they are the same
however the restaurants are dealt to tasks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from leafgrid.llm import textnum

#: Dishes of more customers draw from a law of the same mean and variance.
EXACT = 64
#: Sweeps of a run before any is averaged, and those averaged (a power of two, 64 at most, so that means are exact).
BURN, SAMPLES = 4, 8
_TURN = np.uint64(0x9E3779B97F4A7C15)


def pair_keys(dish: np.ndarray, restaurant: np.ndarray) -> np.ndarray:
    """One name for a dish in a restaurant."""
    return textnum.mix(dish + textnum.mix(restaurant.astype(np.uint64) + np.uint64(1)) * _TURN)


def chances(keys: np.ndarray, turn: int) -> np.ndarray:
    """A number between 0 and 1 for each key in a turn."""
    with np.errstate(over="ignore"):
        return ((textnum.mix(keys + np.uint64(turn + 1) * _TURN) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@lru_cache(maxsize=8)
def log_stirling(most: int, discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for c, t up to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            stay = out[c, t] + np.log(np.maximum(c - discount * t, 0))
        out[c + 1, t] = np.logaddexp(out[c, t - 1], stay)
    return out


def draw_tables(c: np.ndarray, a: np.ndarray, discount: float, keys: np.ndarray, turn: int) -> np.ndarray:
    """A number of tables for each dish of c customers, by weights a**t * S(c, t)."""
    stirling = log_stirling(EXACT, discount)
    t = np.minimum(c, 1).astype(np.int64)
    r = chances(keys, 2 * turn)
    order = np.argsort(np.minimum(c, EXACT + 1).astype(np.uint8), kind="stable")
    bounds = np.searchsorted(c[order], np.arange(2, EXACT + 2)) if len(c) else np.zeros(EXACT, np.int64)
    with np.errstate(divide="ignore"):
        log_a = np.log(a)
    for k in range(2, EXACT + 1):
        at = order[bounds[k - 2] : bounds[k - 1]]
        if len(at):
            w = log_a[at, None] * np.arange(1, k + 1) + stirling[k, 1 : k + 1]
            w = np.exp(w - w.max(axis=1, keepdims=True)).cumsum(axis=1)
            t[at] = 1 + (w < r[at, None] * w[:, -1:]).sum(axis=1)
    large = np.flatnonzero(c > EXACT)
    if len(large):
        mean, var = table_moments(c[large], a[large], discount)
        t[large] = np.clip(1 + _counts(mean - 1, var, r[large], chances(keys[large], 2 * turn + 1)), 1, c[large])
    return t


def _counts(mean: np.ndarray, var: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Counts of a given mean and variance: of a binomial law by its sums, of a normal one where the mean is large."""
    out = np.rint(mean + np.sqrt(var) * np.sqrt(-2 * np.log(r)) * np.cos(2 * np.pi * s)).astype(np.int64)
    few = np.flatnonzero(mean <= 40)
    if len(few):
        mean, r = mean[few], r[few]
        less = np.maximum(mean - var[few], 1e-9)
        n = np.maximum(np.rint(np.minimum(mean * mean / less, 1e9)), np.ceil(mean))
        q = np.minimum(mean / np.maximum(n, 1), 1 - 1e-12)
        term = np.exp(n * np.log1p(-q))
        total, k = term.copy(), np.zeros(len(few), np.int64)
        for i in range(1, 120):
            more = r > total
            if not more.any():
                break
            k[more] += 1
            term = term * np.maximum(n - i + 1, 0) / i * (q / (1 - q))
            total += term
        out[few] = np.minimum(k, n)
    return out


def table_moments(c: np.ndarray, a: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the number of tables by weights a**t * S(c, t), for many customers.

    The weights are those of a Poisson number of tables given the sum of their sizes, whose
    generating function is exp(a / d * (1 - (1 - x)**d)); x is set so that the sum has the mean c.
    A test holds mean and spread to a few hundredths of the exact ones.
    """
    low, high = np.zeros(len(c)), np.maximum(np.log(c / a), 0) / (1 - discount) + 50  # of -log(1 - x)
    for _ in range(60):
        z = (low + high) / 2
        over = np.log(a) + np.log(-np.expm1(-z)) + (1 - discount) * z > np.log(c)
        low, high = np.where(over, low, z), np.where(over, z, high)
    y = np.exp(-high)
    tables = -a / discount * np.expm1(-discount * high)
    g = y + (1 - y) * (1 - discount)
    edge = (1 - y) * (1 - discount) / (2 * g * g)  # of many tables; of few ones it is 1, the table that holds most
    return np.minimum(tables + 1 + (edge - 1) * tables / (tables + 80), c), np.maximum(tables - c * y / g, 0)


def seat_dishes(c: np.ndarray, place: np.ndarray, known: np.ndarray, p: np.ndarray, keys: np.ndarray, strength: float, discount: float, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Mean number of tables of each dish over the sampled sweeps, and the last sample.

    c: customers of each dish; place: its restaurant; known: the tables of each restaurant that
    is dealt to several tasks, by the run before, and nan for one that is here as a whole; p: what the
    parent gives each dish. Dishes without customers have no table.
    """
    t = np.minimum(c, 1).astype(np.int64)
    many = np.flatnonzero(c > 1)
    total = np.zeros(len(many))
    single = np.bincount(place[c == 1], minlength=len(known))
    at, cm, pm, km = place[many], c[many], p[many], keys[many]
    for sweep in range(BURN + samples):
        tables = np.where(np.isnan(known), single + np.bincount(at, t[many], len(known)), known)
        t[many] = draw_tables(cm, (strength + discount * tables[at]) * pm, discount, km, sweep)
        if sweep >= BURN:
            total += t[many]
    mean = t.astype(np.float64)
    mean[many] = total / samples
    return mean, t
