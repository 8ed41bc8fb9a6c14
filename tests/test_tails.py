import math
from decimal import Decimal, localcontext
from itertools import combinations

import numpy as np
import pytest

from dyadic.functions import tails


@pytest.mark.parametrize("t, df", [(2.776445, 4), (2.228139, 10), (12.706205, 1), (1.959964, 1e7)])
def test_t_table_values(t, df):
    assert tails.t_two_sided(t, df) == pytest.approx(0.05, abs=1e-6)


def test_t_edges():
    assert tails.t_two_sided(0.0, 5) == 1.0
    assert np.isnan(tails.t_two_sided(1.0, 0))
    assert np.isnan(tails.t_two_sided(np.nan, 5))
    assert 0 < tails.t_two_sided(60.0, 40) < 1e-30


def test_f_agrees_with_squared_t():
    for t, df in ((0.5, 3), (2.0, 11), (4.0, 200)):
        assert tails.f_upper(t * t, 1, df) == pytest.approx(tails.t_two_sided(t, df), rel=1e-12)


def test_f_two_degrees_closed_form():
    assert tails.f_upper(3.0, 2, 10) == pytest.approx((1 + 2 * 3.0 / 10) ** -5, rel=1e-12)


def test_boundary_lrt():
    assert list(tails.boundary_lrt(np.array([-1.0, 0.0]))) == [1.0, 1.0]
    assert tails.boundary_lrt(np.array([3.841459]))[0] == pytest.approx(0.025, abs=1e-6)


def test_hypergeometric_by_enumeration():
    total, marked, drawn = 9, 4, 3
    draws = list(combinations(range(total), drawn))
    for k in range(0, 5):
        exact = sum(sum(i < marked for i in d) >= k for d in draws) / len(draws)
        assert tails.hypergeom_upper(k, total, marked, drawn) == pytest.approx(exact, abs=1e-12)


def test_hypergeometric_large():
    p = tails.hypergeom_upper(60, 850_000, 40_000, 555)
    assert 0 < p < 1e-6 and math.isfinite(p)


def exact_t(t, df):
    """Two-sided Student tail for even degrees of freedom by its finite sum, in 60 digits."""
    with localcontext() as context:
        context.prec = 60
        t, n = Decimal(t), Decimal(df)
        term, total = Decimal(1), Decimal(0)
        for k in range(df // 2):
            total += term
            term = term * n / (n + t * t) * (2 * k + 1) / (2 * k + 2)
        return float(1 - (t * t / (n + t * t)).sqrt() * total)


@pytest.mark.parametrize("df", [20_000, 60_000])
def test_t_large_degrees(df):
    """Many values at once: each stands still at its own step of the fraction."""
    t = np.array([1e-6, 0.01, 0.5, 1.7, 1.74, 2.0, 5.0, 9.0])
    many = np.concatenate([t, np.random.default_rng(3).normal(size=2000) * 2])
    got = tails.t_two_sided(many, np.full(len(many), df))
    assert np.isfinite(got).all()
    assert got[: len(t)] == pytest.approx([exact_t(float(v), df) for v in t], rel=1e-12)


def test_t_reaches_the_normal():
    t = np.linspace(0.0, 8.0, 500)
    assert tails.t_two_sided(t, 1e12) == pytest.approx([math.erfc(v / math.sqrt(2)) for v in t], rel=1e-9)


def test_f_large_degrees():
    f = np.linspace(0.5, 2.0, 400)
    assert tails.f_upper(f, 2, 1e7) == pytest.approx((1 + 2 * f / 1e7) ** -5e6, rel=1e-8)
    assert tails.f_upper(f, 1, 200_000) == pytest.approx(tails.t_two_sided(np.sqrt(f), 200_000), rel=1e-12)
    assert np.isfinite(tails.f_upper(f, 64, 1e6)).all() and np.isfinite(tails.f_upper(f, 1e5, 1e5)).all()
