import math

import numpy as np
import pytest

from ramify.functions import numerics as num
from ramify.functions.splines import anova_p, gam, group_gam


@pytest.mark.parametrize(("x", "d1", "d2", "p"), [(4.0, 1, 10, 0.073388), (1.0, 5, 5, 0.5), (3.0, 2, 20, 0.0725382)])
def test_f_tail(x, d1, d2, p):
    assert num.f_sf(x, d1, d2) == pytest.approx(p, rel=1e-4)


def test_chi2_and_inverse():
    assert math.exp(num.chi2_log_sf(3.841459, 1)) == pytest.approx(0.05, rel=1e-5)
    assert num.chi2_from_log_sf(math.log(0.05), 10) == pytest.approx(18.307, rel=1e-4)


def test_t_quantile():
    assert num.t_quantile(0.025, 10) == pytest.approx(2.228139, rel=1e-5)


def test_far_tails_stay_finite():
    assert -5000 < num.f_log_sf(500.0, 50, 500) < -300


def test_bh():
    assert num.bh(np.array([0.01, 0.04, 0.03, 0.5])) == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_average_ranks():
    assert num.average_ranks(np.array([3.0, 1.0, 3.0, 2.0])).tolist() == [3.5, 1.0, 3.5, 2.0]


def test_line_needs_two_degrees():
    t = np.linspace(0, 1, 60)
    fit = gam(t, 3 * t + 1)
    assert fit.edf == pytest.approx(2, abs=0.05) and fit.deviance == pytest.approx(0, abs=1e-8)


def test_curve_is_followed():
    rng = np.random.default_rng(0)
    t = np.sort(rng.random(300))
    fit = gam(t, np.sin(6 * t) + 0.1 * rng.standard_normal(300), k=10)
    assert np.sqrt(np.mean((fit.fitted - np.sin(6 * t)) ** 2)) < 0.05


def test_constant_has_no_deviance():
    fit = gam(np.linspace(0, 1, 30), np.full(30, 2.0))
    assert fit.deviance == pytest.approx(0, abs=1e-10)


def test_groups_and_interactions():
    rng = np.random.default_rng(1)
    t, g = rng.random(400), np.repeat([0, 1], 200)
    y = np.where(g == 1, np.sin(6 * t), 0) + 0.2 * rng.standard_normal(400)
    assert anova_p(group_gam(t, y, g), group_gam(t, y, g, by=False)) < 1e-6
    assert group_gam(t, y + 2 * g, g).p_value(1) < 1e-6
    flat = 0.2 * rng.standard_normal(400)
    assert group_gam(t, flat, g).p_value(1) > 1e-3


def test_more_knots_hardly_change_a_fit():
    from ramify.functions import splines

    rng = np.random.default_rng(4)
    x = np.sort(rng.random(1500)) ** 2
    y = np.sin(6 * x) + 0.2 * rng.standard_normal(1500)
    few, many = (s.columns(x) for s in (splines.thin_plate(x, 8), splines.thin_plate(x, 8, max_knots=1500)))
    fits = [c @ np.linalg.lstsq(c, y, rcond=None)[0] for c in (np.column_stack([np.ones(1500), b]) for b in (few, many))]
    assert np.abs(fits[0] - fits[1]).max() < 0.01
