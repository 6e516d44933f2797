"""Tests, regressions and similarity against small closed cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineside.functions.special import t_two_sided
from lineside.operators import association as A
from lineside.operators import leadlag, regression, similarity


def test_correlations_too_short_or_perfect(frame):
    df = frame([("two", 1.0, 2.0), ("two", 2.0, 1.0), ("line", 1.0, 2.0), ("line", 2.0, 4.0), ("line", 3.0, 6.0), ("line", None, 1.0)],
               "g string, x double, y double")
    out = {r.g: r for r in A.correlate(df, "x", "y", ["g"]).collect()}
    assert out["two"].pearson_r is None and out["two"].n == 2
    assert out["line"].n == 3 and out["line"].pearson_r == pytest.approx(1.0) and out["line"].pearson_p == pytest.approx(0.0, abs=1e-6)


def test_rank_tests_on_a_textbook_sample(frame):
    # ranks of a: 1, 2, 3, 4.5; of b: 4.5, 6, 7, 8
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 5.0)] + [("b", v) for v in (5.0, 6.0, 7.0, 9.0)]
    df = frame(rows, "g string, v double")
    u = A.mann_whitney(df, "v", F.col("g") == "a", F.col("g") == "b").first()
    assert (u.n1, u.n2, u.u) == (4, 4, 0.5)
    spread = math.sqrt(16 / 12 * (9 - 6 / 56))
    assert u.p == pytest.approx(math.erfc((15.5 - 8 - 0.5) / spread / math.sqrt(2)))
    k = A.kruskal_wallis(df, "v", "g").first()
    raw = 12 / 72 * (10.5**2 / 4 + 25.5**2 / 4) - 27
    assert k.h == pytest.approx(raw / (1 - 6 / (512 - 8)))
    assert A.kruskal_wallis(df.where("g = 'a'"), "v", "g").count() == 0


def test_wilcoxon_drops_zeros(frame):
    row = A.wilcoxon_signed_rank(frame([(0.0,), (1.0,), (-2.0,), (3.0,), (4.0,)], "d double"), "d").first()
    assert (row.n, row.statistic) == (4, 2.0)


def test_t_tests(frame):
    df = frame([(1.0, 0.0), (2.0, 0.5), (4.0, 1.0)], "a double, b double")
    d = np.array([1.0, 1.5, 3.0])
    t = d.mean() / (d.std(ddof=1) / np.sqrt(3))
    row = A.paired_t(df, "a", "b").first()
    assert row.t == pytest.approx(t) and row.p == pytest.approx(float(t_two_sided(t, 2)))
    assert row.ci_upper - row.mean == pytest.approx(4.302653 * row.sd / np.sqrt(3), abs=1e-5)


def test_ols_matches_least_squares_and_survives_collinearity(frame):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=40)
    df = frame([(float(a), float(b), float(2 * a), float(c)) for (a, b), c in zip(x, y)], "a double, b double, a2 double, y double")
    design = np.column_stack([np.ones(40), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    rest = ((y - design @ beta) ** 2).sum()
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rest / 37)
    fits = regression.fit_models(df, "y", {"small": ["a"], "large": ["a", "b"]})
    got = {r.feature: r for r in fits.where("model = 'large'").collect()}
    assert [got[f].coefficient for f in ("intercept", "a", "b")] == pytest.approx(list(beta))
    assert [got[f].std_error for f in ("intercept", "a", "b")] == pytest.approx(list(se))
    f = regression.nested_f(fits, {"b": ("small", "large")}).first()
    assert f.f_stat == pytest.approx(got["b"].t_value ** 2) and f.f_p == pytest.approx(got["b"].p_value)
    twin = {r.feature: r for r in regression.fit_ols(df, "y", ["a", "b", "a2"]).collect()}
    assert twin["a"].coefficient + 2 * twin["a2"].coefficient == pytest.approx(beta[1])


def test_cluster_robust_of_single_row_clusters_is_white(frame):
    rng = np.random.default_rng(5)
    x = rng.normal(size=30)
    y = 2 * x + rng.normal(size=30) * (1 + np.abs(x))
    df = frame([(float(a), float(b), i) for i, (a, b) in enumerate(zip(x, y))], "x double, y double, c int")
    design = np.column_stack([np.ones(30), x])
    bread = np.linalg.inv(design.T @ design)
    e = y - design @ (bread @ design.T @ y)
    cov = bread @ (design.T * e**2) @ design @ bread * 30 / 29 * 29 / 28
    got = {r.feature: r.cluster_se for r in regression.cluster_robust(df, "y", ["x"], "c").collect()}
    assert [got["intercept"], got["x"]] == pytest.approx(list(np.sqrt(np.diag(cov))))


def test_granger_of_constant_or_short_series_is_null(frame):
    rows = [("flat", i, 1.0, float(i % 3)) for i in range(40)] + [("short", i, float(i), float(i * i)) for i in range(8)]
    out = leadlag.granger(frame(rows, "e string, m int, x double, y double"), "e", "m", "x", "y").collect()
    assert all(r.best_lag is None and r.p_value is None for r in out) and {r.n_months for r in out} == {40, 8}


def test_centre_correlations(frame):
    rng = np.random.default_rng(1)
    base = rng.normal(size=30)
    series = {e: base * s + rng.normal(size=30) * 0.1 for e, s in (("a", 1), ("b", 1), ("c", -1), ("f", -1))}
    series |= {"k": np.full(30, 0.7)}
    rows = [(e, i, 1e8 * (e == "a") + float(x)) for e, xs in series.items() for i, x in enumerate(xs)] + [("d", i, float(i)) for i in range(10)]
    members = frame([(e, "two", "up" if e in "abk" else "down") for e in "abcdfk"], "e string, family string, centre string")
    out = {(r.e, r.centre): r for r in similarity.centre_correlations(frame(rows, "e string, m int, v double"), members, "e", "m", "v").collect()}
    for e in "abcf":
        for centre, inside in (("up", "abk"), ("down", "cf")):
            others = [1e8 * (o == "a") + series[o] for o in inside if o != e]
            means = [np.mean([x[i] for x in others] + ([float(i)] if centre == "down" and i < 10 else [])) for i in range(30)]
            assert out[e, centre].correlation == pytest.approx(np.corrcoef(series[e], means)[0, 1], abs=1e-6)
    assert out["k", "up"].imputed and out["d", "up"].imputed and not out["a", "up"].imputed
    assert out["k", "up"].correlation == pytest.approx(np.median([r.correlation for r in out.values() if not r.imputed]))


def test_grouping_takes_the_family_with_the_best_silhouette(frame):
    rows = [(e, family, centre, r) for e, near in (("a", "x"), ("b", "x"), ("c", "y"))
            for family, centre, r in (("good", "x", 0.9 if near == "x" else 0.1), ("good", "y", 0.9 if near == "y" else 0.1), ("poor", "p", 0.5), ("poor", "q", 0.5))]
    groups, scores = similarity.co_movement(frame(rows, "e string, family string, centre string, correlation double"), "e")
    assert sorted((r.node, r.cluster, r.cluster_size) for r in groups.collect()) == [("a", "x", 2), ("b", "x", 2), ("c", "y", 1)]
    assert {r.family: (round(r.silhouette, 9), r.n_groups) for r in scores.collect()} == {"good": (round(0.8 / 0.9, 9), 2), "poor": (0.0, 1)}


def test_rank_correlation_of_tiny_values(frame):
    rows = frame([(1e-13 * (i + 1), float(i)) for i in range(10)], "x double, y double")
    assert A.correlate(rows, "x", "y").first().spearman_r == pytest.approx(1.0)


def test_signed_rank_p_is_counted_without_ties(frame):
    import itertools
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 9, 12):
        d = rng.permutation(np.arange(1, n + 1)) * rng.choice([-1.0, 1.0], n)
        sums = np.array([sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)])
        w = min(d[d > 0].sum(), -d[d < 0].sum())
        row = A.wilcoxon_signed_rank(frame([(float(x),) for x in d], "d double"), "d").first()
        assert row.statistic == w and row.p == pytest.approx(min(1.0, 2 * (sums <= w).mean()))
    # ties, zeros and more than 50 values take the normal form
    for values in ([1.0, 1.0, -2.0], [0.0, 1.0, -2.0, 3.0], [float(i) * (-1) ** (i % 3) for i in range(1, 52)]):
        kept = [v for v in values if v]
        row = A.wilcoxon_signed_rank(frame([(v,) for v in values], "d double"), "d").first()
        n, ties = len(kept), sum(c ** 3 - c for c in (sum(abs(v) == u for v in kept) for u in {abs(v) for v in kept}))
        z = abs(row.statistic - n * (n + 1) / 4) / math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
        assert row.p == pytest.approx(min(1.0, math.erfc(z / math.sqrt(2))))


def test_welch_value(frame):
    a, b = [0.71, 0.74, 0.69, 0.80], [0.61, 0.66, 0.70, 0.58, 0.64]
    df = frame([("a", v) for v in a] + [("b", v) for v in b] + [("c", 9.0), ("a", None)], "g string, v double")
    row = A.welch_t(df, "v", F.col("g") == "a", F.col("g") == "b").first()
    e1, e2 = np.var(a, ddof=1) / 4, np.var(b, ddof=1) / 5
    t, freedom = (np.mean(a) - np.mean(b)) / math.sqrt(e1 + e2), (e1 + e2) ** 2 / (e1 ** 2 / 3 + e2 ** 2 / 4)
    assert (row.n1, row.n2) == (4, 5) and row.t == pytest.approx(t) and row.df == pytest.approx(freedom)
    # the tail by a sum over Student's density
    x = np.linspace(t, 400, 4_000_001)
    density = math.gamma((freedom + 1) / 2) / math.gamma(freedom / 2) / math.sqrt(freedom * math.pi) * (1 + x * x / freedom) ** (-(freedom + 1) / 2)
    assert row.p == pytest.approx(2 * np.trapezoid(density, x), rel=1e-5)


def test_granger_equals_least_squares(frame):
    from lineside.functions.special import f_upper
    rng, rows, series = np.random.default_rng(12), [], {}
    for e, n in (("lead", 60), ("noise", 45), ("big", 50), ("least", 20)):
        x = rng.normal(size=n) * (1e6 if e == "big" else 1) + (5e6 if e == "big" else 0)
        y = np.r_[np.zeros(2), 0.7 * x[:-2]] + rng.normal(size=n) if e == "lead" else rng.normal(size=n)
        series[e] = x, y
        rows += [(e, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    rows += [("gap", i, None if i == 7 else float(i % 5), float(i % 3)) for i in range(40)]
    tests = leadlag.granger(frame(rows, "e string, m int, x double, y double").repartition(3), "e", "m", "x", "y")
    assert "InPandas" not in tests._jdf.queryExecution().optimizedPlan().toString().replace("MapInPandas", "")
    got = {r.e: r for r in tests.collect()}
    assert got["gap"].p_value is None and got["gap"].best_lag is None and got["gap"].n_months == 40
    for e, (x, y) in series.items():
        best = (None, 0.0, 1.0)
        for lag in range(1, 7):
            n = len(y)
            own = np.column_stack([np.ones(n - lag)] + [y[lag - j:n - j] for j in range(1, lag + 1)])
            full = np.column_stack([own] + [x[lag - j:n - j] for j in range(1, lag + 1)])
            rest = [float(((y[lag:] - d @ np.linalg.lstsq(d, y[lag:], rcond=None)[0]) ** 2).sum()) for d in (own, full)]
            freedom = n - lag - 2 * lag - 1
            if freedom > 0:
                f = (rest[0] - rest[1]) / lag / (rest[1] / freedom)
                best = min(best, (lag, f, float(f_upper(f, lag, freedom))), key=lambda b: b[2])
        assert got[e].best_lag == best[0] and got[e].f_stat == pytest.approx(best[1], rel=1e-6) and got[e].p_value == pytest.approx(best[2], rel=1e-5)
