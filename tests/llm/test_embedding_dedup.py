import numpy as np
import pytest

from folia.llm import embedding_dedup as e


def brute(rows, threshold=0.95):
    width = 16
    best = {}
    for i, v in rows:
        ok = v and len(v) == width and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if i is not None and ok:
            best[i] = min(best.get(i, v), v)
    ids = sorted(best)
    x = np.array([best[i] for i in ids])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    home = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for k, i in enumerate(ids):
            least = min([home[i], *(home[ids[j]] for j in np.flatnonzero(near[k]))])
            changed, home[i] = changed or least < home[i], least
    out = {i: (0, i, i is not None) for i, _ in rows}
    return out | {i: (int(near[k].sum()), home[i], home[i] == i) for k, i in enumerate(ids)}


def check(spark, rows):
    df = spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], "vec_id long, embedding array<double>, node int, v double").repartition(3)
    got = [(r.vec_id, (r.n_links, r.component_id, r.kept)) for r in e.near_vectors(df).collect()]
    assert len(got) == len(dict(got))
    assert dict(got) == brute(rows)


def groups(seed):
    """Pairs, a chain, a wide group whose links must be compared, a tight group, copies, and alone ones."""
    r = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v)
    out = [r.normal(size=16) for _ in range(150)]
    out += [v + 0.02 * r.normal(size=16) for v in out[:40]]
    step = unit(r.normal(size=16))
    turn = unit(r.normal(size=16))
    out += [np.cos(0.25 * k) * step + np.sin(0.25 * k) * unit(turn - (turn @ step) * step) for k in range(9)]
    base = unit(r.normal(size=16))
    out += [base + 0.055 * r.normal(size=16) for _ in range(90)]
    tight = r.normal(size=16)
    out += [tight + 0.02 * r.normal(size=16) for _ in range(70)]
    out += [out[0]] * 60
    return [(int(k), v.tolist()) for k, v in zip(r.permutation(len(out)), out)]


def test_against_all_pairs(spark):
    rows = groups(1)
    odd = [None, [], [0.0] * 16, [1.0] * 15 + [None], [1.0] * 15 + [float("nan")], [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    rows += [(2000 + k, v) for k, v in enumerate(odd)] + [(None, [1.0] * 16), (3, [1e300] * 16), (2100, [1e300] * 16), rows[5]]
    check(spark, rows)


def test_blocks_and_shells_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 7)
    check(spark, groups(2))


def test_saturated_lists_are_doubled(spark):
    rows = [(1, k, 0.99, False) for k in range(2, 12)] + [(2, k, 0.5, False) for k in range(3, 15)]
    graph = e.merged(spark.createDataFrame(rows, "u long, v long, s float, old boolean"), None, "t")
    assert {(r.u, r.room): r["count"] for r in graph.groupBy("u", "room").count().collect()} == {(1, 2 * e.LIST): e.LIST, (2, e.LIST): e.LIST}


def test_audit_counts_missing_links(spark):
    v = [[1.0, 0.0], [1.0, 0.1], [1.0, 0.2], [0.0, 1.0]]
    nodes = spark.createDataFrame([(k, 1, e.unit(np.array([x]))[0].tolist()) for k, x in enumerate(v)], "node long, copies long, v array<double>")
    whole = spark.createDataFrame([(0, 3), (1, 3), (2, 3)], "node long, n long")
    half = spark.createDataFrame([(0, 2), (1, 3), (2, 2)], "node long, n long")
    assert e.audit(nodes, whole, 0.95) == 1.0 and e.audit(nodes, half, 0.95) == pytest.approx(4 / 6)


def test_recall_without_clusters(spark):
    """Pairs at the threshold among vectors that have nothing in common, wider than a sketch."""
    r = np.random.default_rng(9)
    x = r.normal(size=(4000, 96))
    x /= np.linalg.norm(x, axis=1)[:, None]
    other = r.normal(size=(400, 96))
    other -= (other * x[:400]).sum(1)[:, None] * x[:400]
    other /= np.linalg.norm(other, axis=1)[:, None]
    near = 0.955 * x[:400] + np.sqrt(1 - 0.955**2) * other
    rows = [(k, v.tolist()) for k, v in enumerate([*x, *near])]
    got = {r.vec_id: r.n_links for r in e.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    found = sum(got[4000 + k] == 1 for k in range(400))
    assert found >= 0.99 * 400 and sum(got.values()) == 2 * found


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert e.near_vectors(none).collect() == []
    alone = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in e.near_vectors(alone).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
