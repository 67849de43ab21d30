import numpy as np
import pandas as pd
import pytest

from folia.llm import ann


def brute(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % every == 0:
            found = sorted(((-float(v @ w), i) for i, w in good if i != q))[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def test_against_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=6).round(2).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5, 0.5, 0.1, 0.2, 0.3, 0.4]) for i in range(60)]  # ties
    rows += [(400, None), (420, []), (440, [0.0] * 6), (460, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (480, [1.0, float("nan"), 1.0, 1.0, 1.0, 1.0]), (500, [1.0, float("inf"), 1.0, 1.0, 1.0, 1.0]), (520, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    got = {}
    for x in ann.search(df, every=20, k=15, least=1_000).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    want = brute(rows, 20, 15)
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 16)) and [f[1] for f in found] == [w[0] for w in want[q]]
        assert np.allclose([f[2] for f in found], [w[1] for w in want[q]], atol=1e-12)


def recall(df, x, ids):
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hit, total = hit + len(want & got[int(ids[k])]), total + 20
    return hit / total


@pytest.mark.parametrize("n", [0, 300, 50_000])
def test_recall_at_the_query_s_own_settings(spark, n):
    """n vectors without clusters, or the table of the tests; the walk prunes at every size."""
    if n:
        x, ids = np.random.default_rng(4).normal(size=(n, 64)), np.arange(n)
        df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": list(x)}))
    else:
        df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
        rows = df.select("vec_id", "embedding").toPandas()
        x, ids = np.stack(rows["embedding"].to_numpy()).astype(float), rows["vec_id"].to_numpy()
    assert recall(df, x, ids) >= 0.9


def test_repeated_ids_and_a_repeated_vector(spark, monkeypatch):
    """A vector that a third of all rows hold fills several blocks; a repeated vec_id asks once for each of its vectors."""
    monkeypatch.setattr(ann, "BLOCK", 32)
    r = np.random.default_rng(5)
    rows = [(i, [1.0, 0.5, 0.2, 0.1] if i % 3 == 0 else r.normal(size=4).tolist()) for i in range(400)] + [(20, [3.0, 0.0, 0.0, 1.0]), (41, [1.0, 0.0, 0.0, 1.0]), (41, [1.0, 0.0, 0.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=10, least=1_000).collect()
    for q in (0, 40, 60, 380):
        v = np.array(dict(rows[:400])[q])
        want = sorted(((-float(np.dot(v, w)), i) for i, w in rows if i != q))[:10]
        assert [(x.vec_id, round(x.score, 9)) for x in sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)] == [(i, round(-s, 9)) for s, i in want]


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [0.5, 0.5])], schema)
    assert ann.search(few).count() == 4
    assert ann.search(few.where("false")).count() == 0
    assert ann.search(spark.createDataFrame([(0, None)], schema)).count() == 0


def test_walk_is_in_order():
    r = np.random.default_rng(2)
    a, b, size = r.normal(size=7), r.normal(size=9), r.integers(0, 4, 63).tolist()
    order = ann.walk(a, b, size, 10**9)
    sums = [a[p // 9] + b[p % 9] for p in order]
    assert sums == sorted(sums, reverse=True) and sorted(order) == [p for p in range(63) if size[p]]
