"""Factor models against known structures and plain formulas."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import factors, models


def structure(n=4000, seed=0):
    rng = np.random.default_rng(seed)
    load = np.zeros((12, 3))
    for k in range(3):
        load[4 * k : 4 * k + 4, k] = [0.8, 0.75, 0.7, 0.65]
    x = rng.normal(size=(n, 3)) @ load.T + rng.normal(size=(n, 12)) * np.sqrt(1 - (load**2).sum(axis=1))
    return load, x


def test_rules_find_three_factors(spark):
    load, x = structure()
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(4)
    folds = models.sums_by(df, "v", F.col("id") % 5)
    m = models.Moments.of(sum(folds.values()))
    assert m.n == len(x) and np.allclose(m.cov, np.cov(x.T, bias=True)) and np.allclose(m.correlations(), np.corrcoef(x.T))
    found = models.suggest(m.n, m.correlations(), folds, 8)
    assert {found[k]["k"] for k in ("map", "empirical_kaiser", "kaiser", "scree_elbow", "cross_validated")} == {3}
    assert all("semantics" in f for f in found.values())


def test_adequacy():
    _, x = structure()
    r = np.corrcoef(x.T)
    a = models.adequacy(len(x), r)
    assert a["p"] < 1e-10 and 0.7 < a["kmo"] < 1 and len(a["kmo_by_item"]) == 12
    noise = np.random.default_rng(3).normal(size=(500, 6))
    assert models.adequacy(500, np.corrcoef(noise.T))["p"] > 0.01
    assert abs(models.upper_gamma(1.0, 2.0) - np.exp(-2)) < 1e-12 and abs(models.upper_gamma(0.5, 0.3) - 0.43857802608099845) < 1e-9 and abs(models.upper_gamma(5.0, 20.0) - 1.6944743e-05) < 1e-10


@pytest.mark.parametrize("method", ["principal", "minres", "ml"])
@pytest.mark.parametrize("rotation", ["varimax", "promax", "oblimin"])
def test_extraction_recovers_the_structure(method, rotation):
    load, x = structure()
    s = models.factor_solution(np.corrcoef(x.T), 3, method, rotation)
    assert min(abs(p) for p in models.compare(load, s.loadings, turn=False)["phi"]) > 0.98
    assert np.allclose(s.communalities, (load**2).sum(axis=1), atol=0.08)


def test_oblique_rotations_find_correlated_factors():
    rng = np.random.default_rng(1)
    phi = np.array([[1, 0.5], [0.5, 1]])
    load = np.kron(np.eye(2), np.full((5, 1), 0.75))
    f = rng.multivariate_normal([0, 0], phi, 6000)
    x = f @ load.T + rng.normal(size=(6000, 10)) * np.sqrt(1 - 0.75**2)
    for rotation in ("promax", "oblimin"):
        s = models.factor_solution(np.corrcoef(x.T), 2, "minres", rotation)
        assert 0.35 < abs(s.phi[0, 1]) < 0.65
        assert np.sort(np.abs(s.loadings), axis=1)[:, 0].max() < 0.12


def test_scores_by_columns(spark):
    _, x = structure(500)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    m = models.Moments.of(sum(models.sums_by(df, "v", F.lit(0)).values()))
    r = m.correlations()
    w = models.score_weights(r, models.factor_solution(r, 3))
    got = np.array([row.scores for row in models.with_scores(df, "v", m, w).orderBy("id").collect()])
    assert np.allclose(got, (x - x.mean(axis=0)) / x.std(axis=0) @ w)


def test_pairs_are_the_best_of_all():
    rng = np.random.default_rng(2)
    for shape in ((3, 3), (3, 5), (5, 3)):
        s = rng.normal(size=shape)
        got = sum(abs(s[r, c]) for r, c, _ in models.best_pairs(s))
        wide = np.abs(s if shape[0] <= shape[1] else s.T)
        assert np.isclose(got, max(sum(wide[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0])))


def test_turned_solutions_compare_as_equal():
    load, _ = structure()
    turn = np.linalg.qr(np.random.default_rng(5).normal(size=(3, 3)))[0]
    c = models.compare(load, load @ turn)
    assert c["median"] > 0.999 and np.allclose(c["aligned"], load, atol=1e-9)
    back, pairs = models.anchored(load, load[:, [2, 0, 1]] * [1, -1, 1], [0, 1, 4, 5, 8, 9])
    assert np.allclose(back, load) and models.band(0.96) == "equal" and models.band(-0.9) == "fair" and models.band(0.2) == "different"
    with pytest.raises(ValueError):
        models.procrustes(load, load[:, :2])


def test_bootstrap_and_splits(spark):
    load, x = structure(1500)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    one = models.bootstrap_loadings(df.repartition(3), "v", F.col("id"), 3, draws=15)
    other = models.bootstrap_loadings(df.repartition(5), "v", F.col("id"), 3, draws=15)
    assert np.allclose(one["low"], other["low"]) and (one["low"] <= one["high"]).all()
    strong = np.abs(one["loadings"]) > 0.5
    assert (one["sign_stability"][strong] == 1).all()
    assert all(s["stable"] for s in models.split_stability(df, "v", F.col("id") % 2, 3))
    assert "split" not in models.sensitivity(np.corrcoef(x.T), 3) and models.sensitivity(np.corrcoef(x.T), 3).count("preserved") == 2


def test_projection_and_rank():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    axes, shares, scale = models.components(models.Moments(300, x.mean(axis=0), np.cov(x.T, bias=True)), 5)
    assert np.isclose(shares.sum(), 1) and np.allclose(axes @ axes.T, np.eye(5)) and np.allclose(scale, x.std(axis=0))
    d = models.back_projected(np.array([1.0, 0, 0, 0, 0]), axes, scale)
    assert np.isclose(np.linalg.norm(d), 1) and np.allclose(d, axes[0] * scale / np.linalg.norm(axes[0] * scale))
    b, a = rng.normal(size=(20, 4)), rng.normal(size=(4, 30))
    b2, a2 = models.reduced_product(b, a, 2)
    assert np.allclose(b2 @ a2, models.reduced(b @ a, 2)) and b2.shape == (20, 2)
    with pytest.raises(ValueError):
        models.reduced(b, 5)


def test_too_few_shared_items(spark):
    a = spark.createDataFrame([(k, 0, 0.5) for k in range(12)], "item int, factor int, loading double")
    assert models.aligned_items(a, a.where("item > 1")).count() == 10
    with pytest.raises(ValueError):
        models.aligned_items(a, a.where("item > 5"))


def test_alpha_bands_and_signs(spark):
    rows = [(k, c, float(k if c else -k) + 0.1 * ((k * 7 + c) % 3)) for k in range(30) for c in range(2)]
    cells = spark.createDataFrame(rows, "k int, col int, value double")
    signs = spark.createDataFrame([(0, -1.0), (1, 1.0)], "col int, sign double")
    assert factors.cronbach(cells, 2, signs).first().alpha > 0.95 and (factors.cronbach(cells, 2).first().alpha or -1) < 0
    got = spark.createDataFrame([(0.96,), (0.85,), (0.2,), (None,)], "a double").select(factors.alpha_band(F.col("a"))).collect()
    assert [r[0] for r in got] == ["redundant", "good", "poor", "n/a"]
