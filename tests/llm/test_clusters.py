import numpy as np
import pytest

from quantloom.llm import clusters as C


def brute(x, ids, limit):
    """Complete clusters of at least one item: {smallest id: members}."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= limit
    out, degree = {}, near.sum(1)
    for i in range(len(ids)):
        row = np.flatnonzero(near[i])
        if (degree[row] == len(row)).all() and near[np.ix_(row, row)].all():
            out[min(ids[j] for j in row)] = sorted(ids[j] for j in row)
    return out


def data(seed, d=64, spread=0.02, n_groups=12):
    rng = np.random.default_rng(seed)
    rows = []
    for size in [*rng.integers(1, 9, n_groups), 70]:
        c = rng.normal(size=d)
        c /= np.linalg.norm(c)
        rows += [(c + rng.normal(size=d) * spread) * rng.choice([0.05, 1, 20]) for _ in range(size)]
    rows += [rows[-1]] * 20  # copies
    return np.array(rows)[rng.permutation(len(rows))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, embedding array<float>, loaded_at timestamp, cluster_id string").repartition(3)


@pytest.mark.parametrize(("seed", "spread", "d"), [(1, 0.03, 64), (4, 0.3, 3)])
def test_complete_clusters(spark, monkeypatch, seed, spread, d):
    monkeypatch.setattr(C, "MEET_LEAVES", 48)
    monkeypatch.setattr(C, "BLOCK_ITEMS", 8)
    x = data(seed, d, spread).astype(np.float32).astype(np.float64)
    rows = [(i * 3, x[i].tolist(), None, "x") for i in range(len(x))]
    got = C.similarity_clusters(frame(spark, rows), node_items=60, dimensions=d).collect()
    assert sorted(r.item_id for r in got) == [r[0] for r in rows]
    complete, all_ = {}, {}
    for r in got:
        all_.setdefault((r.cluster_id, r.complete), []).append((r.item_id, r.size))
        if r.complete:
            complete.setdefault(r.cluster_id, []).append(r.item_id)
    assert {k: sorted(v) for k, v in complete.items()} == brute(x, [r[0] for r in rows], 0.82)
    assert all(size == len(v) for v in all_.values() for _, size in v)
    u = {i * 3: x[i] / np.linalg.norm(x[i]) for i in range(len(x))}
    for v in all_.values():  # every cluster holds similar items only
        m = np.stack([u[i] for i, _ in v])
        assert (m @ m.T).min() >= 0.82 - 1e-6


def test_typical_items_of_a_cut_cluster(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ITEMS", 8)
    rng = np.random.default_rng(7)
    centres = np.linalg.qr(rng.normal(size=(64, 64)))[0][:6]
    x = np.concatenate([c + rng.normal(size=(20, 64)) * 0.045 for c in centres])
    rows = [(i, v.tolist(), None, "x") for i, v in enumerate(x)]
    vectors = C.unit_vectors(frame(spark, rows))
    assert C.assign_leaves(vectors, 0.82, 30)[1].count() > 6  # the tree cuts them
    got = C.similarity_clusters(frame(spark, rows), node_items=30)
    u = {r.item_id: np.array(r.vec) / np.linalg.norm(r.vec) for r in vectors.collect()}
    members = {}
    for r in got.collect():
        members.setdefault((r.cluster_id, r.complete), {})[r.item_id] = r.cosine
    want = {}
    for key, v in members.items():
        total = sum(u[i] for i in v)
        cosine = {i: float(u[i] @ total / np.linalg.norm(total)) for i in v}
        assert all(abs(cosine[i] - c) < 1e-9 for i, c in v.items())
        want[key] = sorted(v, key=lambda i, cosine=cosine: (-round(cosine[i], 9), i))[:3]
    assert any(k[1] and len(v) == 20 for k, v in members.items())
    assert {(r.cluster_id, r.complete): r.typical_items for r in C.describe_clusters(got).collect()} == want


def test_dirty_rows(spark):
    from datetime import datetime

    a, b = [1.0] * 64, [1.0, -1.0] * 32
    t = [datetime(2024, 1, k + 1) for k in range(3)]
    rows = [(1, a, t[0], "x"), (1, b, t[1], "x"), (1, [float("nan")] * 64, t[2], "x"), (2, b, t[0], "x"), (2, b, t[0], "x"), (3, [2 * v for v in b], None, "x"), (4, None, t[0], "x"), (5, a[:63], t[0], "x"), (6, [0.0] * 64, t[0], "x"), (7, [float("inf"), *a[1:]], t[0], "x"), (None, a, t[0], "x"), (8, [None, *a[1:]], t[0], "x"), (9, a, t[0], "x"), (10, [1e-30 * v for v in a], t[0], "x")]
    got = {r.item_id: (r.cluster_id, r.size, r.complete) for r in C.similarity_clusters(frame(spark, rows)).collect()}
    assert got == {1: (1, 3, True), 2: (1, 3, True), 3: (1, 3, True), 9: (9, 2, True), 10: (9, 2, True)}
    described = C.describe_clusters(C.similarity_clusters(frame(spark, rows)), 2)
    assert {r.cluster_id: (r.size, r.typical_items) for r in described.collect()} == {1: (3, [1, 2]), 9: (2, [9, 10])}
    assert C.similarity_clusters(frame(spark, [])).count() == 0


def test_large_compact_node_is_not_gathered(spark):
    rng = np.random.default_rng(5)
    c = rng.normal(size=64)
    rows = [(i, (c + rng.normal(size=64) * 0.01).tolist(), None, "x") for i in range(150)] + [(1000 + i, rng.normal(size=64).tolist(), None, "x") for i in range(50)]
    vectors = C.unit_vectors(frame(spark, rows))
    items, leaves = C.assign_leaves(vectors, 0.82, 100)
    figures = {r.leaf: r for r in leaves.collect()}
    assert any(r.n > 60 and k & C._WIDE for k, r in figures.items()) and sum(r.n for r in figures.values()) == 200
    members = {}
    for r in items.collect():
        members.setdefault(r.leaf, []).append((r.item_id, r.h, np.array(r.vec, dtype=float)))
    for k, v in members.items():
        u = np.stack([x / np.linalg.norm(x) for _, _, x in v])
        centre = u.sum(0) / np.linalg.norm(u.sum(0))
        r = figures[k]
        assert (r.n, r.least, r.hx) == (len(v), min(i for i, _, _ in v), int(np.bitwise_xor.reduce([h for _, h, _ in v])))
        assert abs(r.low - (u @ centre).min()) < 1e-6 and np.allclose(r.centre, centre, atol=1e-6)
    got = C.similarity_clusters(frame(spark, rows), node_items=100).collect()
    assert {r.cluster_id for r in got if r.item_id < 1000 and r.complete and r.size == 150} == {0}


@pytest.mark.parametrize(("trees", "pass_nodes"), [(1, 3), (3, 4), (2, 2_048)])
def test_every_row_comes_to_one_node_of_each_tree(spark, trees, pass_nodes):
    rng = np.random.default_rng(6)
    rows = [(i, i, rng.normal(size=8).tolist()) for i in range(300)] + [(300 + i, i, [1.0] * 8) for i in range(60)]
    df = spark.createDataFrame(rows, "item_id long, h long, vec array<float>").repartition(4)
    got = C.grow(df, ["item_id", "h"], 0.95, 20, 8, trees, pass_nodes=pass_nodes).collect()
    assert len(got) == 360 * trees
    nodes = {}
    for r in got:
        nodes.setdefault((r.node, r.state), []).append(r)
    assert len({k for k, _ in nodes}) == len(nodes) and len(nodes) > 15 * trees
    for (_, leaf), v in nodes.items():
        u = np.stack([np.array(r.vec) / np.linalg.norm(r.vec) for r in v])
        assert len(v) <= 20 if leaf < 0 else (u @ u.T).min() > 2 * 0.95**2 - 1 - 1e-6
    copies = [r for r in got if r.item_id >= 300]
    assert len({r.node for r in copies}) == trees and all(r.state == 0 for r in copies)
    assert C.grow(df.limit(0), ["item_id", "h"], 0.95, 20, 8).count() == 0
