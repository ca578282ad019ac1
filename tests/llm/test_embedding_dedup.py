import numpy as np

from tesserae.llm import embedding_dedup as E


def frame(spark, x, extra=()):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rep", "'k' as key")


def brute(x):
    x = x.astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    return (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)


def data():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 32))
    near = []
    for i in range(250):
        step = rng.normal(size=32)
        step *= np.linalg.norm(x[i]) * rng.uniform(0.05, 0.47) / np.linalg.norm(step)
        near.append(x[i] + step)
    return np.vstack([x, near, np.repeat(x[:1], 30, 0)])


def test_recall_and_precision_against_brute_force(spark):
    x = data()
    want = brute(x)
    got = {r.vec_id: r for r in E.near_duplicates(frame(spark, x)).collect()}
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= want.sum(1)).all()
    assert n.sum() >= 0.95 * want.sum()
    for i, r in got.items():
        assert r.component_id <= i and r.kept == (r.component_id == i)
    assert len({got[i].component_id for i in (0, *range(1150, 1180))}) == 1


def test_small_tiles_change_nothing(spark, monkeypatch):
    x = data()[:400]
    one = sorted(map(tuple, E.near_duplicates(frame(spark, x)).collect()))
    monkeypatch.setattr(E, "TILE_ROWS", 7)
    assert sorted(map(tuple, E.near_duplicates(frame(spark, x)).collect())) == one


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [-1.0, 0.0]), (9, []), (10, [1.0]), (11, [1.0, -0.0]), (11, [1.0, -0.0]), (12, [0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(frame(spark, np.empty((0, 2)), odd)).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[11] == (3, 1, False)
    for i in (3, 4, 5, 6, 7, 8, 9, 10, 12):
        assert got[i] == (0, i, True)
    assert E.near_duplicates(frame(spark, np.empty((0, 2)))).count() == 0


def test_traversal_visits_cells_by_cost():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = E.MultiIndex(x, 5000)
    one, two = index.costs(x[:20])
    for r in range(20):
        cost = (one[r][:, None] + two[r][None]).ravel()
        got = index.traverse(one[r], two[r])
        assert sorted(got) == np.flatnonzero(cost <= index.bound).tolist()
        assert (np.diff(cost[got]) >= 0).all()
