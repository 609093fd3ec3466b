import math

import brute
import numpy as np

from refbank.llm import embeddings as V

SCHEMA = "vec_id long, embedding array<float>, label int, row string, cell int"


def data(n_groups=12, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    out, i = [], 0
    for g in range(n_groups):
        base = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 30))):
            out.append((i, (base + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.2])).astype(np.float32).tolist(), g % 3, "r", 1))
            i += 1
    out += [(i, out[0][1], out[0][2], "r", 1), (i + 1, [x * 3 for x in out[0][1]], out[0][2], "r", 1),
            (i + 2, out[0][1], None, "r", 1), (i + 3, None, 0, "r", 1), (i + 4, [0.0] * dim, 0, "r", 1),
            (i + 5, [None] + [1.0] * (dim - 1), 0, "r", 1), (i + 6, [math.nan] + [1.0] * (dim - 1), 0, "r", 1),
            (i + 7, [math.inf] + [1.0] * (dim - 1), 0, "r", 1), (i + 8, [], 0, "r", 1),
            (i + 9, [1.0, 2.0], 0, "r", 1), (i + 10, [2.0, 4.0], 0, "r", 1), (i + 11, [1e30] * dim, 1, "r", 1), (i + 12, [1e-30] * dim, 1, "r", 1)]
    return out


def expected(rows, t=0.98):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, np.float64)
        a /= np.abs(a).max()
        return a / np.linalg.norm(a)

    u = [unit(r[1]) for r in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if u[a] is not None and u[b] is not None
             and rows[a][2] is not None and rows[a][2] == rows[b][2] and len(u[a]) == len(u[b]) and u[a] @ u[b] >= t]
    root = brute.union_find(range(len(rows)), pairs)
    n = [0] * len(rows)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    least = {}
    for i, r in enumerate(rows):
        least[root[i]] = min(least.get(root[i], r[0]), r[0])
    return sorted((r[0], n[i], least[root[i]], r[0] == least[root[i]]) for i, r in enumerate(rows))


def test_matches_brute_force_with_full_recall(spark):
    rows = data()
    got = sorted(map(tuple, V.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()))
    want = expected(rows)
    assert sum(r[1] for r in want) > 300
    assert got == want


def test_small_blocks_split_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 7)
    rows = [(r[0], r[1], 1, *r[3:]) for r in data(4, seed=3)]
    got = sorted(map(tuple, V.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == expected(rows)


def test_repeated_ids_and_empty_table(spark):
    rows = [(1, [1.0, 0.0], 0, "r", 1), (1, [1.0, 0.0], 0, "r", 1), (2, [0.0, 1.0], 0, "r", 1)]
    got = sorted(map(tuple, V.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]
    assert V.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_traversal_visits_cells_in_order():
    rng = np.random.default_rng(2)
    u, v = rng.random(9), rng.random(7)
    seen = list(V.traverse(u, v, 0.9))
    costs = [u[i] + v[j] for i, j in seen]
    assert costs == sorted(costs) and len(set(seen)) == len(seen)
    assert len(seen) == int((u[:, None] + v[None] <= 0.9).sum())


def test_bound_never_exceeds_the_distance_to_a_cell():
    rng = np.random.default_rng(4)
    c, x, y = rng.normal(size=(12, 5)), rng.normal(size=(40, 5)), rng.normal(size=(400, 5))
    low, cell = V.bounds(x, c), V.squared(y, c).argmin(1)
    assert (V.squared(x, y) >= low[:, cell] - 1e-9).all()
