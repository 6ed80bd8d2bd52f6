import numpy as np
import pytest

from probestack.operators import cca
from probestack.plans.experiments import run_cca, views
from probestack.sources.readers import read_folds, read_parameters
from probestack.sources.writers import write_table

rng = np.random.default_rng(0)


def rowwise(fitted, x, y):
    """The score from the rows themselves, on full-rank views."""
    px, py = fitted.proj_x, fitted.proj_y
    k = min(len(px), len(py))
    ax, ay = x[:, fitted.keep_x].T, y[:, fitted.keep_y].T
    dx, dy = px[:k] @ (ax - ax.mean(1, keepdims=True)), py[:k] @ (ay - ay.mean(1, keepdims=True))
    r = np.array([np.corrcoef(a, b)[0, 1] for a, b in zip(dx, dy, strict=True)])
    a, d = (ax, dx) if len(ax) < len(ay) else (ay, dy)
    q, _ = np.linalg.qr((d + a.mean(1)[:k, None]).T)
    w = np.abs(q.T @ a[:k].T).sum(axis=1)
    return float(w / w.sum() @ r)


def both(x, y):
    return cca.moments_of(np.hstack([x, y]))


def test_moments_equal_rows():
    x = rng.standard_normal((400, 16)) + 3
    y = x[:, :10] @ rng.standard_normal((10, 10)) + rng.standard_normal((400, 10))
    fitted = cca.fit(both(x[:300], y[:300]), 16, 1e-8, 1e-8)
    assert cca.score(fitted, both(x[300:], y[300:]), 16) == pytest.approx(rowwise(fitted, x[300:], y[300:]), abs=1e-9)
    a, b = cca.moments_of(x[:100]), cca.moments_of(x[100:])
    assert np.allclose((a + b).scatter / 399, np.cov(x.T))


def test_linear_map_of_itself_is_about_one_and_noise_about_zero():
    x = rng.standard_normal((2000, 8))
    y = x @ rng.standard_normal((8, 8))
    f = cca.fit(both(x[:1000], y[:1000]), 8, 1e-9, 1e-9)
    assert cca.score(f, both(x[1000:], y[1000:]), 8) == pytest.approx(1, abs=1e-5)
    z = rng.standard_normal((2000, 8))
    f = cca.fit(both(x[:1000], z[:1000]), 8, 1e-9, 1e-9)
    assert abs(cca.score(f, both(x[1000:], z[1000:]), 8)) < 0.2


def test_one_dimension_is_a_signed_correlation():
    x = rng.standard_normal((300, 1))
    y = -x + rng.standard_normal((300, 1))
    f = cca.fit(both(x[:200], y[:200]), 1, 1e-9, 1e-9)
    want = -np.corrcoef(x[200:, 0], y[200:, 0])[0, 1]
    assert cca.score(f, both(x[200:], y[200:]), 1) == pytest.approx(want, abs=1e-9)


def test_degenerate_views():
    x, flat = rng.standard_normal((50, 3)), np.zeros((50, 2))
    assert cca.score(cca.fit(both(x, flat), 3, 1e-8, 1e-8), both(x, flat), 3) == 0.0
    hot = np.eye(4)[rng.integers(0, 4, 200)]
    x = rng.standard_normal((200, 6))
    s = cca.score(cca.fit(both(x[:150], hot[:150]), 6, 1e-8, 1e-8), both(x[150:], hot[150:]), 6)
    assert np.isfinite(s) and -1 <= s <= 1
    with pytest.raises(np.linalg.LinAlgError):
        cca.fit(both(x[:5], hot[:5]), 6, 1e-8, 1e-8)
    assert np.isnan(cca.score(cca.fit(both(x, hot), 6, 1e-6, 1e-6), both(x[:2], hot[:2]), 6))


def test_experiments(spark):
    n = 600
    v = rng.standard_normal((n, 4))
    rows = [(i, f"w{i % 3}", layer, [float(t) for t in (v[i] if layer == 0 else rng.standard_normal(4))]) for i in range(n) for layer in (0, 1)]
    reps = spark.createDataFrame(rows, "row_id long, label string, layer int, vec array<double>")
    second = spark.createDataFrame([(i, [float(t) for t in v[i] @ np.array([[1.0, 2, 0, 1], [0, 1, 1, 0], [3, 0, 1, 0], [0, 0, 1, 5]])]) for i in range(n)], "row_id long, vec array<double>")
    got = {r.layer: (r.score, r.n_trials) for r in run_cca("cca-intra", reps, second).collect()}
    assert got[0] == (pytest.approx(1, abs=1e-4), 3) and abs(got[1][0]) < 0.5
    words = spark.createDataFrame([("w0", [1.0, 0.0]), ("w1", [0.0, 1.0])], "word string, vec array<double>")
    kept = views("glove", reps, words, max_per_label=20)
    assert kept.count() == 2 * 40 and {r.label for r in kept.select("label").distinct().collect()} == {"w0", "w1"}
    with pytest.raises(ValueError):
        views("nothing", reps, words)


def test_moments_by_blocks_and_bounded_sums(spark):
    x = rng.standard_normal((300, 7))
    rows = [("g" if i % 3 else None, i % 4, [float(v) for v in x[i, :4]], [float(v) for v in x[i, 4:]]) for i in range(300)]
    frame = spark.createDataFrame(rows, "layer string, fold int, v1 array<double>, v2 array<double>").repartition(3)
    for held, cells in ((1 << 20, 1 << 16), (1, 10)):  # with 1, a task hands on every sum at once; 10 cells are a row of the matrix
        got = {(r.layer, r.fold): r for r in cca.fold_moments(frame, ["layer"], held_bytes=held, block_cells=cells).collect()}
        assert len(got) == 8
        for (layer, fold), r in got.items():
            mine = x[[i for i in range(300) if i % 4 == fold and bool(i % 3) == (layer == "g")]]
            assert r.d1 == 4 and r.n == len(mine) and np.allclose(r.s, mine.sum(axis=0)) and np.allclose(np.reshape(r.m, (7, 7)), mine.T @ mine)


def test_mean_of_views_is_the_mean_of_both_weightings():
    x = rng.standard_normal((400, 6)) + 1
    y = x[:, :4] @ rng.standard_normal((4, 4)) + rng.standard_normal((400, 4))
    f, held = cca.fit(both(x[:300], y[:300]), 6, 1e-8, 1e-8), both(x[300:], y[300:])
    px, py, k = f.proj_x, f.proj_y, 4
    dx, dy = px[:k] @ (x[300:] - x[300:].mean(0)).T, py[:k] @ (y[300:] - y[300:].mean(0)).T
    r = np.array([np.corrcoef(a, b)[0, 1] for a, b in zip(dx, dy, strict=True)])
    want = []
    for a, d in ((x[300:].T, dx), (y[300:].T, dy)):
        q, _ = np.linalg.qr((d + a.mean(1)[:k, None]).T)
        w = np.abs(q.T @ a[:k].T).sum(axis=1)
        want.append(float(w / w.sum() @ r))
    assert cca.score(f, held, 6, mean_of_views=True) == pytest.approx(np.mean(want), abs=1e-9)
    assert cca.score(f, held, 6) == pytest.approx(want[1], abs=1e-9)


def test_stored_projections_score_alike(spark, tmp_path):
    x = rng.standard_normal((500, 5))
    y = x[:, :3] + rng.standard_normal((500, 3))
    rows = [(0, i % 10, [float(v) for v in x[i]], [float(v) for v in y[i]]) for i in range(500)]
    moments = cca.fold_moments(spark.createDataFrame(rows, "layer int, fold int, v1 array<double>, v2 array<double>"), ["layer"])
    write_table(cca.cca_parameters(moments, ["layer"]), f"{tmp_path}/p")
    stored = read_parameters(spark, f"{tmp_path}/p")
    folds = {r.fold: cca.Moments(r.n, np.array(r.s), np.reshape(r.m, (8, 8))) for r in moments.collect()}
    f = cca.fit(cca._sum([folds[k] for k in range(2, 10)]), 5, 1e-6, 1e-6)
    for mean in (False, True):
        got = cca.score_stored(stored, moments, ["layer"], (0, 1), mean).first().score
        assert got == pytest.approx(cca.score(f, folds[0] + folds[1], 5, mean), abs=1e-9)


def test_a_failing_trial_is_replaced():
    def fold(n, scale=1.0):
        z = rng.standard_normal((n, 2)) * scale
        return cca.moments_of(z)

    folds = {k: fold(40) for k in range(10)}
    assert sorted({(r.dev_fold, r.test_fold) for r in cca.trial_scores(folds, 1).itertuples()}) == [(0, 1), (2, 3), (4, 5)]
    del folds[2]  # the second pair cannot be scored
    done = cca.trial_scores(folds, 1)
    assert sorted({(r.trial, r.dev_fold, r.test_fold) for r in done.itertuples()}) == [(0, 0, 1), (1, 4, 5), (2, 6, 7)]
    assert (done.groupby("trial").size() == cca.ENOUGH).all()


def test_given_folds(spark, tmp_path):
    import os

    os.makedirs(f"{tmp_path}/folds")
    for k in range(10):
        with open(f"{tmp_path}/folds/split{k}.lst", "w") as out:
            out.write("\n".join(str(i) for i in range(200) if i % 10 == k))
    folds = read_folds(spark, f"{tmp_path}/folds")
    assert {(r.row_id, r.fold) for r in folds.collect()} == {(i, i % 10) for i in range(200)}
    x = rng.standard_normal((200, 2))
    reps = spark.createDataFrame([(i, "w", 0, [float(v) for v in x[i]]) for i in range(200)], "row_id long, label string, layer int, vec array<double>")
    second = spark.createDataFrame([(i, [float(x[i, 0] + x[i, 1]), float(x[i, 0])]) for i in range(200)], "row_id long, vec array<double>")
    for mean in (False, True):
        got = run_cca("intra", reps, second, folds=folds, mean_of_views=mean).first()
        assert got.score == pytest.approx(1, abs=1e-4) and got.n_trials == 3
