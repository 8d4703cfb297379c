"""Validation of factor models against plain versions that hold all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import models as mo
from colloquy.operators import validation as v

N, P = 400, 12


@pytest.fixture(scope="module")
def data():
    """Two factors on ten items, two items of noise; ids are no places."""
    rng = np.random.default_rng(4)
    f = rng.normal(size=(N, 2))
    load = np.zeros((2, P))
    load[0, :5], load[1, 5:10] = 0.8, 0.7
    return f @ load + rng.normal(size=(N, P)) * 0.6 + np.linspace(-2, 2, P)


@pytest.fixture(scope="module")
def rows(spark, data):
    out = [(3 * k + 1, x.tolist(), k % 3) for k, x in enumerate(data)]
    return spark.createDataFrame(out + [(5000, None, 0), (5001, [None] + [0.0] * (P - 1), 1), (5002, [float("nan")] * P, 2)], "id long, x array<double>, g int").repartition(5)


ID = "id"


def test_rows_and_items(spark, rows, data):
    got = {r.item: r for r in v.row_item_validation(rows, "x", F.col(ID), 2, strata=("g",), seen=5, trials=2, splits=2, rotation="varimax", seed=3).collect()}
    rng, found = np.random.default_rng(3), {n: [[] for _ in range(P)] for n in ("main", "shuffle", "fewer", "item_mean")}
    for split in range(2):
        sides = v.halves(rows.withColumns({"__id": F.col(ID), "__all": F.lit(0)}), 0.7, 3 + 1000 + split, ["g"], "__id")
        of = {r.id: r.side for r in sides.collect()}
        a, b = (np.array([x for k, x in enumerate(data) if of[3 * k + 1] == s]) for s in "AB")
        order = [r.id for r in v.in_parts(v.vectors(sides.where("side = 'B'"), "x", F.col(ID)), v.PART_ROWS).collect()]
        b = np.array([data[(i - 1) // 3] for i in order])
        mean = a.mean(axis=0)
        fits = [mo.factor_solution(np.corrcoef(a.T), k, "principal", "varimax") for k in (2, 1)]
        r2 = lambda y, guess: 1 - ((y - guess) ** 2).sum(axis=0) / ((y - y.mean(axis=0)) ** 2).sum(axis=0)
        for trial in range(2):
            at = v.choose_items(rng, P, 5)
            out = np.setdiff1d(np.arange(P), at)
            guesses = []
            for s in fits:
                l, psi = s.loadings, np.maximum(1 - s.communalities, 1e-6)
                scores = (b[:, at] - mean[at]) @ np.linalg.inv(l[at] @ l[at].T + np.diag(psi[at])) @ l[at]
                guesses.append(scores)
            turn = np.random.default_rng([3 + split, trial, 0]).permutation(len(b))
            for name, guess in (("main", guesses[0] @ fits[0].loadings[out].T), ("shuffle", guesses[0][turn] @ fits[0].loadings[out].T), ("fewer", guesses[1] @ fits[1].loadings[out].T)):
                for j, x in zip(out, r2(b[:, out], guess + mean[out])):
                    found[name][j].append(x)
        for j, x in enumerate(r2(b, mean)):
            found["item_mean"][j].append(x)
    for j in range(P):
        for name, lists in found.items():
            want = np.mean(lists[j]) if lists[j] else None
            assert (got[j][name] is None) == (want is None) and (want is None or np.isclose(got[j][name], want, atol=1e-8)), (j, name)
    assert np.mean([got[j].main for j in range(10) if got[j].main is not None]) > 0.2
    s = v.validation_summary(spark.createDataFrame(list(got.values()))).collect()[0]
    assert s.passes and s.main > s.fewer and s.shuffle < 0.05


def test_items_are_chosen_by_factor():
    load = np.zeros((12, 2))
    load[:9, 0], load[9:, 1] = 1, 1
    for k in range(20):
        picks = v.choose_items(np.random.default_rng(k), 12, 6, load)
        assert len(set(picks)) == 6 and (picks >= 9).sum() == 3
    assert len(v.choose_items(np.random.default_rng(0), 12, 9, load)) == 9


def plain_eigenvalues(x):
    return np.linalg.eigvalsh(np.corrcoef(x.T))[::-1]


def test_permuted_items(rows, data):
    got = v.permuted_eigenvalues(rows, "x", F.col(ID), 5, 1).toPandas()
    order = [r.id for r in v.in_parts(v.vectors(rows, "x", F.col(ID)), v.PART_ROWS).collect()]
    x = np.array([data[(i - 1) // 3] for i in order])
    for d in range(5):
        want = plain_eigenvalues(np.random.default_rng([1, d, 0]).permuted(x - x.mean(axis=0), axis=0))
        assert np.allclose(got[got.draw == d].sort_values("rank").e, want)
    found = v.permutation_analysis(rows, "x", F.col(ID), draws=60)
    assert found["leading"] == found["total"] == 2
    many = v.permutation_analysis(rows, "x", F.col(ID), draws=60, part_rows=60)
    assert many["leading"] == 2 and np.abs(many["thresholds"] - found["thresholds"]).max() < 0.08


def test_both_counts_of_parallel_analysis():
    passes = np.array([True, True, False, True])
    assert mo.leading(passes) == 2 and passes.sum() == 3


def test_shuffled_data_have_no_factors(rows):
    assert v.shuffle_control(rows, "x", F.col(ID), draws=60)["passes"]


def test_held_out_items(rows, data):
    held = [1, 7, 10, 11]
    got = {r["item"]: r for r in v.item_holdout(rows, "x", F.col(ID), held, 2, folds=4, permutations=60, floor=0.05, rotation="varimax", seed=9, part_rows=150).collect()}
    assert all(got[j].passes and got[j].p_value == 0 and got[j].r2 > 0.3 for j in (1, 7))
    assert all(not got[j].passes and got[j].r2 < 0.05 for j in (10, 11))
    train = [j for j in range(P) if j not in held]
    r = np.corrcoef(data[:, train].T)
    z = (data[:, train] - data[:, train].mean(axis=0)) / data[:, train].std(axis=0)
    scores = np.c_[z @ mo.score_weights(r, mo.factor_solution(r, 2, "principal", "varimax")), np.ones(N)]
    folds = {r.id: r.f for r in rows.select("id", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(4)).alias("f")).collect()}
    fold = np.array([folds[3 * k + 1] for k in range(N)])
    for j in held:
        r2 = []
        for f in range(4):
            b = np.linalg.lstsq(scores[fold != f], data[fold != f, j], rcond=None)[0]
            y = data[fold == f, j]
            r2.append(1 - ((y - scores[fold == f] @ b) ** 2).sum() / ((y - y.mean()) ** 2).sum())
        assert np.isclose(got[j].r2, np.mean(r2), atol=1e-8)


def test_step_up(spark):
    for seed in range(4):
        rng = np.random.default_rng(seed)
        p = np.round(rng.uniform(0, 1, 30) ** 3, 2)
        order = np.argsort(p, kind="stable")
        ok = np.flatnonzero(p[order] <= np.arange(1, 31) / 30 * 0.1)
        limit = p[order][ok.max()] if len(ok) else -1
        got = v.step_up(spark.createDataFrame([(float(x),) for x in p], "p double"), "p", 0.1).collect()
        assert sorted((r.p, r.significant) for r in got) == sorted((float(x), bool(x <= limit)) for x in p)


def test_split_items(rows, data):
    groups = ["a", "b", "c"] * 4
    got = {(r.split, r.factor): r.r for r in v.split_items(rows, "x", 1, groups, draws=2, seed=5, rotation=None).collect()}
    assert {k for k, _ in got} == {"half_0", "half_1", "a vs rest", "b vs rest", "c vs rest", "a vs b", "a vs c", "b vs c"}

    def scores(items):
        r = np.corrcoef(data[:, items].T)
        z = (data[:, items] - data[:, items].mean(axis=0)) / data[:, items].std(axis=0)
        return z @ mo.score_weights(r, mo.factor_solution(r, 1, "principal", None))

    for name, (a, b) in (("half_1", v.item_halves(groups, 6)), ("a vs rest", (np.arange(0, P, 3), np.setdiff1d(np.arange(P), np.arange(0, P, 3))))):
        assert np.isclose(got[name, 0], np.corrcoef(scores(a)[:, 0], scores(b)[:, 0])[0, 1])
    assert v.split_summary(v.split_items(rows, "x", 1, groups, draws=3, by_group=False)).collect()[0].n == 3


def plain_correlation(x, y, w, ranks):
    x, y = np.repeat(x, w), np.repeat(y, w)
    if ranks:
        x, y = ((np.searchsorted(s := np.sort(c), c) + np.searchsorted(s, c, side="right") + 1) / 2 for c in (x, y))
    return np.corrcoef(x, y)[0, 1] if len(x) and x.std() > 0 and y.std() > 0 else 0.0


@pytest.mark.parametrize("method", ["spearman", "pearson"])
def test_paired_bootstrap(spark, method):
    rng = np.random.default_rng(8)
    out = [(g, k, float(x), float(x + e)) for g, noise in (("tight", 1), ("loose", 4)) for k, (x, e) in enumerate(zip(rng.integers(0, 6, 80), rng.integers(-noise, noise + 1, 80)))]
    odd = [("few", 1, 1.0, 2.0), ("few", 2, 2.0, 3.0), ("flat", 1, 1.0, 1.0), ("flat", 2, 1.0, 2.0), ("flat", 3, 1.0, 3.0), ("tight", 900, None, 1.0), ("tight", 901, float("nan"), 1.0), ("tight", 902, 1.0, float("inf"))]
    df = spark.createDataFrame(out + odd, "g string, id long, x double, y double").repartition(7)
    got = {r.g: r for r in v.paired_bootstrap(df, ["g"], "x", "y", "id", method=method, draws=40, seed=2).collect()}
    assert got["few"].n == 2 and got["few"].r is None and got["few"].low is None and got["flat"].r is None and got["flat"].high is None
    w = {(r.id, r.d): r.w for r in spark.range(0, 80).select("id", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("d")).withColumn("w", v.weight(F.lit(2), F.col("d"), F.col("id"))).collect()}
    assert 0.9 < np.mean(list(w.values())) < 1.1 and 0.9 < np.var(list(w.values())) < 1.1
    for g in ("tight", "loose"):
        x, y = (np.array([r[k] for r in out if r[0] == g]) for k in (2, 3))
        r = [plain_correlation(x, y, [w[k, d] for k in range(80)], method == "spearman") for d in range(1, 41)]
        assert np.isclose(got[g].r, plain_correlation(x, y, [1] * 80, method == "spearman")) and got[g].n == 80
        assert np.allclose([got[g].low, got[g].high], np.quantile(r, [0.025, 0.975]))
    with pytest.raises(ValueError):
        v.paired_bootstrap(df, ["g"], "x", "y", "id", method="kendall")


def test_draws_are_made_once_by_plain_columns(spark):
    """The bootstrap's counts are read back from a table, and a weight is no loop over an array for each row and draw."""
    df = spark.createDataFrame([(k, float(k % 5), float(k % 3)) for k in range(60)], "id long, x double, y double")
    plan = v.paired_bootstrap(df.withColumn("g", F.lit(1)), ["g"], "x", "y", "id", draws=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "xxhash64" not in plan
    assert "aggregate(" not in spark.range(3).select(v.weight(F.lit(1), F.col("id")))._jdf.queryExecution().optimizedPlan().toString()


def test_intervals_cover(spark):
    """Of many samples the interval holds the true correlation about as often as it says."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 60))
    y = 0.6 * x + 0.8 * rng.normal(size=x.shape)
    df = spark.createDataFrame([(s, k, float(x[s, k]), float(y[s, k])) for s in range(120) for k in range(60)], "s int, id long, x double, y double").withColumn("key", F.xxhash64("s", "id"))
    got = v.paired_bootstrap(df, ["s"], "x", "y", "key", method="pearson", draws=150, confidence=0.9).collect()
    assert 0.78 < np.mean([r.low <= 0.6 <= r.high for r in got]) < 0.97


def test_verdict_over_traits(spark):
    m = spark.createDataFrame([(0, "a", 0.5), (1, "a", -0.1), (0, "b", -0.3), (0, "c", 0.2), (0, "d", None)], "factor int, trait string, r double")
    assert tuple(v.validity_verdict(m, 0.3, 2).collect()[0]) == (4, 2, True) and not v.validity_verdict(m, 0.3, 3).collect()[0].passes
