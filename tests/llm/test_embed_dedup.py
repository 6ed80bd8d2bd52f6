import numpy as np

from probestack.llm.embed_dedup import Geometry, linked, near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def planted(seed=0, n=300, dims=64):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dims))
    near = base[:60] + rng.standard_normal((60, dims)) * rng.uniform(0, 0.5, (60, 1))
    blob = base[0] + rng.standard_normal((80, dims)) * 0.25
    v = np.vstack([base, near, near[:10], 3 * base[5:8], blob]).astype(np.float32)
    return v, rng.integers(0, 2, len(v)) * 0 + np.arange(len(v)) % 3 // 2


def brute_force(v, labels, threshold=0.93):
    v = v.astype(float)
    norm = np.linalg.norm(v, axis=1)
    link = (v @ v.T / np.outer(norm, norm) >= threshold) & (labels[:, None] == labels[None])
    np.fill_diagonal(link, False)
    low = np.arange(len(v))
    while True:
        new = np.minimum(low, np.where(link, low[None], len(v)).min(axis=1))
        if (new == low).all():
            return link.sum(axis=1), low
        low = new


def test_links_and_components_equal_brute_force(spark):
    v, labels = planted()
    links, low = brute_force(v, labels)
    assert links.max() > 20
    rows = [(i, [float(x) for x in v[i]], int(labels[i]), "x") for i in range(len(v))]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for chunk in (2048, 16):  # the small one cuts slabs into many chunks
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(frame, chunk=chunk).collect()}
        assert got == {i: (links[i], low[i], low[i] == i) for i in range(len(v))}


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (11, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in near_duplicates(frame).collect())
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (0, 0, 0, True)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)])
    assert near_duplicates(frame.limit(0)).collect() == []


def test_each_pair_in_one_block_only():
    v, _ = planted(1)
    g = Geometry(0.93, {64: v.astype(float)})
    seen = [(int(a), int(b)) for block in range(4) for i, j in linked(v.astype(float), v.astype(float), block, True, g) for a, b in zip(i, j, strict=True)]
    links, _ = brute_force(v, np.zeros(len(v)))
    assert len(seen) == len(set(seen)) == links.sum() // 2


def test_double_vectors_of_any_finite_size(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e-200, 1e-200], 1), (3, [1.0, 1.05], 1), (4, [5e-324, 0.0], 1), (5, [1e308, 1e300], 1), (6, [0.0, -0.0], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4), (6, 0, 6)]
