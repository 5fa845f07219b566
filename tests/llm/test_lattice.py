import collections

import numpy as np

from codeloom.llm import lattice
from codeloom.llm.lattice import ROOTS, cells, decoded, near_vectors

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    good = {i: (np.array(v, float), l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links, parent = collections.Counter(), {i: i for i, _, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(good)
    for a in ids:
        for b in ids:
            (x, l), (y, m) = good[a], good[b]
            if a < b and l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return links, {i: find(i) for i in parent}


def test_agrees_with_brute_force(spark):
    r = np.random.default_rng(1)
    rows = []
    for c in range(40):
        base = r.standard_normal(64)
        for _ in range(int(r.integers(1, 12))):
            rows.append((len(rows), (base + r.standard_normal(64) * r.uniform(0, 0.3)).tolist(), c % 3))
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(5)]
    out = near_vectors(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rep", "2 as cell", "3 as root")).collect()
    links, roots = brute(rows)
    assert len(out) == len(rows)
    assert sum(x.n_links for x in out) >= 0.97 * sum(links.values()) and all(x.n_links <= links[x.vec_id] for x in out)
    assert sum(x.component_id == roots[x.vec_id] for x in out) >= 0.97 * len(out)


def test_a_crowded_cell_counts_each_link_once_and_sends_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 16)
    sent = {}
    staged = lattice.stage
    monkeypatch.setattr(lattice, "stage", lambda df, label: sent.setdefault(label, staged(df, label)))
    r = np.random.default_rng(4)
    base = r.standard_normal(32)
    rows = [(k, (base + r.standard_normal(32) * 0.1).tolist(), 1) for k in range(150)] + [(k, r.standard_normal(32).tolist(), 1) for k in range(150, 180)]
    out = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    links, roots = brute(rows)
    assert {x.vec_id: (x.n_links, x.component_id) for x in out} == {k: (links[k], roots[k]) for k in roots}
    assert sent["links"].count() < sum(links.values()) / 4


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0] * 3, 1), (8, [None, 2.0, 3.0], 1), (9, [float("nan"), 2.0, 3.0], 1), (10, [float("inf"), 2.0, 3.0], 1), (11, [2.0, 4.0, 6.0], 1), (12, [1e200, 2e200, 3e200], 1), (13, [1.0, 2.0], 1), (None, v, 1), (2, v, 1)]
    out = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    for r in out:
        linked = r.vec_id in (1, 2, 11, 12)
        assert r.n_links == (3 if linked else 0)
        assert r.component_id == (1 if linked else r.vec_id)
        assert r.kept == (r.component_id == r.vec_id or r.vec_id is None)


def test_several_vectors_of_one_id_keep_all_their_links(spark):
    a, b = np.eye(8)[0], np.eye(8)[1]
    near = lambda v: (v + 0.01 * np.eye(8)[7]).tolist()
    rows = [(7, a.tolist(), 1), (7, b.tolist(), 1), (8, near(a), 1), (9, near(b), 1), (6, np.eye(8)[2].tolist(), 1)]
    out = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == [(6, 0, 6, True), (7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 7, False)]


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_decoding_finds_the_nearest_point():
    y = np.random.default_rng(2).uniform(-2, 2, (300, 8))
    own = decoded(y)
    best = ((y - own) ** 2).sum(axis=1)
    assert len(ROOTS) == 240 and np.allclose((ROOTS**2).sum(axis=1), 2)
    for root in ROOTS:
        assert (((y - own - root) ** 2).sum(axis=1) >= best - 1e-9).all()
    doubled = (own * 2).astype(int)
    assert ((doubled % 2 == 0).all(axis=1) | (doubled % 2 == 1).all(axis=1)).all() and (own.sum(axis=1) % 2 == 0).all()


def test_pairs_at_the_threshold_share_a_cell():
    r = np.random.default_rng(3)
    a = r.standard_normal((1000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.standard_normal(a.shape)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    for cosine, least in ((0.93, 0.97), (0.95, 0.99), (0.99, 1.0)):
        x, y = cells(a), cells(cosine * a + np.sqrt(1 - cosine**2) * b)
        hit = (x[:, :, :1] == y).any(axis=(1, 2)) | (y[:, :, :1] == x).any(axis=(1, 2))
        assert hit.mean() >= least
