"""Table counts of Pitman-Yor restaurants, drawn for all customers of a dish at once.

Given the other dishes of a restaurant, c customers of one dish sit at t tables with probability proportional to
S(c, t) a(0) ... a(t - 1): S are generalised Stirling numbers of the discount, a(k) = p (A + d k) is the weight of the
next table, with p the parent's probability and A the strength plus d times the tables of other dishes. Drawing t from this
is a Gibbs step that seats every customer of the dish anew. Up to `EXACT` customers all t are weighed; beyond that
Metropolis steps move t, with S from its alternating sum where t is at most c^d (ratios right to 1e-7), and from a saddle point
otherwise (ratios right to a few hundredths).
"""

from __future__ import annotations

import math

import numpy as np

EXACT = 64
STEPS = 12
_TERMS = 64
# Weights made at once.
_CELLS = 1 << 18


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For positive numbers: the asymptotic series at x + 8."""
    x = np.asarray(x, float)
    product = np.ones_like(x)
    for k in range(8):
        product = product * (x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(product)


def stirling_table(n: int, d: float) -> np.ndarray:
    """log S(c, t) for c and t up to n, minus infinity where t > c or t = 0 < c."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(n):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[c] + np.log(np.maximum(c - d * np.arange(n + 1), 0))
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay[1:])
    return out


def _by_sum(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    top = log_gamma(c - d)
    total, choose = np.zeros(len(c)), np.zeros(len(c))
    for j in range(1, _TERMS):
        with np.errstate(divide="ignore"):
            choose = choose + np.log(np.maximum(t - j + 1, 0) / j)
        size = choose + math.lgamma(1 + j * d) + log_gamma(c - j * d) - top
        total += (-1) ** (j + 1) * math.sin(math.pi * j * d) / math.pi * np.exp(size)
    return np.log(np.maximum(total, 1e-300)) + top - log_gamma(t + 1) - t * math.log(d)


def _by_saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    low, high = np.full(len(c), -200.0), np.full(len(c), -1e-12)
    for _ in range(60):
        u = (low + high) / 2
        y = np.exp(u)
        rising = c * -np.expm1(d * u) * np.exp((1 - d) * u) > t * d * -np.expm1(u)
        low, high = np.where(rising, low, u), np.where(rising, u, high)
    y = np.exp(u)
    x, rest = -np.expm1(u), -np.expm1(d * u)
    q = d * np.exp((d - 1) * u) / rest
    spread = x * x * t * (d * (1 - d) * np.exp((d - 2) * u) / rest - q * q) + x * t * q
    value = t * np.log(rest / d) - c * np.log(x) - 0.5 * np.log(2 * math.pi * np.maximum(spread, 1e-300))
    return np.where(t >= c, 0.0, log_gamma(c + 1) - log_gamma(t + 1) + value)


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) for c above EXACT and 1 <= t <= c."""
    c, t = np.asarray(c, float), np.asarray(t, float)
    out = np.empty(len(c))
    few = t <= np.maximum(c**d, 8)
    out[few] = _by_sum(c[few], t[few], d)
    out[~few] = _by_saddle(c[~few], t[~few], d)
    return out


def draw_tables(t: np.ndarray, c: np.ndarray, p: np.ndarray, others: np.ndarray, d: float, draw) -> np.ndarray:
    """New table counts for c >= 1 customers each; `others` is A, `t` the counts so far (0 where there are none)."""
    out = np.minimum(c, 1).astype(np.int64)
    table = stirling_table(EXACT, d)
    for size in np.unique(c[(c > 1) & (c <= EXACT)]).astype(int).tolist():
        rows = np.flatnonzero(c == size)
        for part in np.split(rows, range(_CELLS // size, len(rows), _CELLS // size)):
            weight = np.cumsum(np.log(p[part, None] * (others[part, None] + d * np.arange(size))), axis=1)
            weight += table[size, 1 : size + 1]
            mass = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[part] = 1 + (mass[:, :-1] < draw.random(len(part))[:, None] * mass[:, -1:]).sum(axis=1)
    many = np.flatnonzero(c > EXACT)
    if len(many):
        out[many] = _walk(t[many], c[many], p[many], others[many], d, draw)
    return out


def _walk(t: np.ndarray, c: np.ndarray, p: np.ndarray, others: np.ndarray, d: float, draw) -> np.ndarray:
    expected = p * others / d
    # a count not drawn before starts near its mean
    t = np.where(t > 0, t, np.clip(1 + expected, 1, np.maximum(c**d, 1))).astype(np.int64)
    step = np.sqrt(1 + expected)
    target = lambda n: log_stirling(c, n, d) + n * np.log(p * d) + log_gamma(others / d + n)
    now = target(t)
    for _ in range(STEPS):
        jump = 1 + np.floor(draw.exponential(size=len(t)) * (step - 1)).astype(np.int64)
        moved = t + np.where(draw.random(len(t)) < 0.5, jump, -jump)
        inside = (moved >= 1) & (moved <= c)
        then = target(np.where(inside, moved, t))
        taken = inside & (np.log(np.maximum(draw.random(len(t)), 1e-300)) < then - now)
        t, now = np.where(taken, moved, t), np.where(taken, then, now)
    return t
