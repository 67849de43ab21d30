import hashlib
from collections import Counter

import numpy as np

from folia.llm import near_dup, suffix_dedup
from folia.llm._hash import shingles


def removed(rows, span):
    seen = Counter(t[i : i + span] for _, t in rows for i in range(len(t) - span + 1))
    out = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int))))
        out.append((d if d is not None else -1, len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def test_repeats_against_brute_force(make, dirty):
    want = removed([(d, (t or "").encode()) for d, t in dirty], 400)
    assert any(w[2] for w in want)
    for hot in (2_000, 0):  # 0: every shared core goes the way of the hot ones
        got = suffix_dedup.remove_repeats(make(dirty), hot=hot).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_planted_passages_are_judged_by_their_bytes(make):
    """Of passages of over 50 words in two documents each, those of 400 bytes or more lose bytes and shorter ones none."""
    import random

    r = random.Random(14)
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    rows, repeats = [], set()
    for k in range(60):
        passage = " ".join(word(r.randrange(8, 10) if k % 2 else r.randrange(4, 6)) for _ in range(r.randrange(51, 60)))
        assert (len(passage) >= 400) == bool(k % 2)
        for d in (3 * k, 3 * k + 1):
            rows.append((d, f"{word(30)} {passage} {word(30)}"))
            repeats |= {d} if k % 2 else set()
        rows.append((3 * k + 2, word(600)))
    got = suffix_dedup.remove_repeats(make(rows)).collect()
    assert {x.doc_id for x in got if x.n_removed} == repeats
    assert {x.doc_id: x.n_bytes for x in got} == {d: len(t) for d, t in rows}


def test_suffix_sort_orders_and_verifies():
    r = np.random.default_rng(3)
    data = r.integers(97, 99, 4_000).astype(np.uint8)
    at = np.sort(r.choice(3_900, 300, replace=False))
    group = np.sort(r.integers(0, 5, 300))
    order, twice = suffix_dedup.suffix_sort(data, at, group, span=12)
    text = data.tobytes()
    for g in range(5):
        own = [text[at[k] : at[k] + 12] for k in order if group[k] == g]
        assert own == sorted(own)
        count = Counter(own)
        assert all(twice[k] == (count[text[at[k] : at[k] + 12]] > 1) for k in np.flatnonzero(group == g))


def test_suffix_sort_compares_bytes_in_small_pieces():
    """24,000 pairs of equal suffixes; 20,000 at once took 85 MB."""
    import tracemalloc

    data = np.tile(np.random.default_rng(6).integers(0, 256, 1_000).astype(np.uint8), 26)
    at = np.arange(25_000).reshape(25, 1_000).T.ravel()
    tracemalloc.start()
    _, twice = suffix_dedup.suffix_sort(data, at, np.repeat(np.arange(1_000), 25), span=400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert twice.all()
    assert peak < 30e6


def test_repeats_take_few_files(spark, make, words, monkeypatch):
    """With many partitions, each task of a step wrote a file, those of every part of a union too."""
    import random

    r = random.Random(9)
    rows = []
    for d in range(300):
        text = [r.choice(words) for _ in range(150)] if d % 3 == 0 else text
        rows.append((d, " ".join([*text[: r.randrange(100, 150)], f"end{d}", *text])))
    files, store = {}, suffix_dedup.stored

    def counted(df, name, *more, **named):
        out = store(df, name, *more, **named)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(suffix_dedup, "stored", counted)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = suffix_dedup.remove_repeats(make(rows), hot=2).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == removed([(d, t.encode()) for d, t in rows], 400)
    assert max(files[name] for name in ("repeat-some", "repeat-steps", "repeat-starts")) <= spark.sparkContext.defaultParallelism


def components(rows, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        if d is not None:
            sets.setdefault(d, set()).add(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {d: find(d) for d in sets}


def test_components_against_brute_force(make, dirty):
    for percent in (80, 85):
        want = components(dirty, percent)
        got = near_dup.near_duplicates(make(dirty), percent).collect()
        assert len(got) == len(dirty)
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None
            else:
                assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_shingle_sizes(dirty):
    for _, t in dirty:
        w = (t or "").encode().lower().split()
        assert len(shingles(t or "")) == (len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)


def test_chain_of_near_copies(make, words):
    """Neighbours link, ends don't: one component by way of the middle."""
    text = (words * 3)[:200]
    rows = []
    for k in range(30):
        rows.append((100 - k, " ".join(text)))
        text = [f"n{k}a", f"n{k}b", *text[2:-1], "end"] if k % 2 else [*text[:-2], f"m{k}", "z"]
    want = components(rows, 85)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(make(rows), 85).collect()} == want


def test_narrow_tables_take_few_files(spark, make, words, monkeypatch):
    """With many partitions, each task of each step wrote a file; only full sets, table rows and roots still do."""
    import random

    r = random.Random(8)
    rows = []
    for d in range(400):
        text = [r.choice(words) for _ in range(60)] if d % 4 == 0 else text
        rows.append((d, " ".join([*text[:-1], f"end{d}"])))
    files, store = {}, near_dup.stored

    def counted(df, name, *more, **named):
        out = store(df, name, *more, **named)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(near_dup, "stored", counted)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(make(rows), 85).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == components(rows, 85)
    most = max(spark.sparkContext.defaultParallelism, 64 // 32)
    assert {"near-members", "near-nodes", "near-pairs", "near-left", "near-links"} <= files.keys()
    assert all(n <= most for name, n in files.items() if name not in ("near-sets", "near-tables", "near-full", "near-roots"))


def test_keep_first_and_empty(make, dirty):
    kept = near_dup.keep_first(make(dirty), 80)
    assert kept.columns == make(dirty).columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and 16 not in ids and {4, 5, 6, 7} <= set(ids) and ids.count(11) == 1
    none = make(dirty).where("false")
    assert near_dup.near_duplicates(none).count() == 0 and suffix_dedup.remove_repeats(none).count() == 0


def test_both_ways_to_components(spark):
    import random

    r = random.Random(6)
    links = [(a, a + r.choice((1, 2, 50))) for a in r.sample(range(3_000), 900)] + [(i, i + 1) for i in range(5_000, 5_060)]
    df = spark.createDataFrame(links, "a long, b long")
    one, many = ({x.node: x.root for x in near_dup.components(df, n).collect()} for n in (10**6, 0))
    assert one == many and one[5_060] == 5_000


def test_crowded_group_near_the_threshold(make):
    """Thousands of copies of one page with every pair around the threshold: many links are met only away from a table's neighbours."""
    import random

    r = random.Random(11)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(3_000):
        at, n = r.randrange(400), r.randrange(20, 30)  # a run of new words: likeness to others from the sizes and overlap of the runs
        rows.append((d, " ".join(f"d{d}x{i}" if (i - at) % 400 < n else w for i, w in enumerate(base))))
    sets = [frozenset(zip(*(t.split()[i:] for i in range(5)))) for _, t in rows]
    ids = {}
    held = np.zeros((len(rows), 396), np.float32)
    for d, s in enumerate(sets):
        for g in s:
            if not any(w[0] == "d" for w in g):
                held[d, ids.setdefault(g, len(ids))] = 1
    both, n = held @ held.T, np.array([len(s) for s in sets])
    linked = 100 * both >= 85 * (n[:, None] + n - both)
    np.fill_diagonal(linked, False)
    root = np.arange(len(rows))
    while True:
        low = np.minimum(root, np.where(linked, root, len(rows)).min(axis=1))
        if (low == root).all():
            break
        root = low
    assert 1 < len(set(root.tolist())) < 1_000
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(make(rows), 85).collect()}
    assert got == dict(enumerate(root.tolist()))


def all_links(rows, percent):
    """Roots by every pair, the shared shingles counted in a matrix."""
    sets = [frozenset(zip(*(t.split()[i:] for i in range(5)))) for _, t in rows]
    met, ids = Counter(g for s in sets for g in s), {}
    shared = [[ids.setdefault(g, len(ids)) for g in s if met[g] > 1] for s in sets]
    held = np.zeros((len(rows), len(ids)), np.float32)
    for d, s in enumerate(shared):
        held[d, s] = 1
    both, n = held @ held.T, np.array([len(s) for s in sets])
    linked = 100 * both >= percent * (n[:, None] + n - both)
    np.fill_diagonal(linked, False)
    root = np.arange(len(rows))
    while True:
        low = np.minimum(root, np.where(linked, root, len(rows)).min(axis=1))
        if (low == root).all():
            return root, int(linked.sum() // 2)
        root = low


def test_a_thousand_near_copies(make):
    """Two to six of 300 words changed in each: tens of thousands of links, every document near the threshold with many others."""
    import random

    r = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(1_000):
        text = list(base)
        for i in r.sample(range(300), r.randint(2, 6)):
            text[i] = f"d{d}x{i}"
        rows.append((d, " ".join(text)))
    root, links = all_links(rows, 85)
    assert links > 20_000 and 100 < len(set(root.tolist())) < 900
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(make(rows), 85).collect()}
    assert got == dict(enumerate(root.tolist()))


def test_repeats_in_a_hot_core(make, words):
    """Two thousand documents share one passage with other surroundings: more runs of a core than are gathered."""
    import random

    r = random.Random(12)
    passage = " ".join(r.choice(words) for _ in range(110))
    rows = [(d, f"{' '.join(f'{r.choice(words)}{r.randrange(99)}' for _ in range(30))} {passage[: r.choice((None, 420, 500))]} {' '.join(f'{r.choice(words)}{r.randrange(99)}' for _ in range(30))}") for d in range(1_500)]
    want = removed([(d, t.encode()) for d, t in rows], 400)
    for hot in (2_000, 100):
        got = suffix_dedup.remove_repeats(make(rows), hot=hot).collect()
        assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == want


def test_rows_kept_of_repeats(make):
    """One row stays of those that share id and text, and of null ids with one text."""
    text = "one two three four five six seven"
    rows = [(5, text), (5, text), (5, "other words that link with nothing at all"), (None, text), (None, text), (None, None), (9, text + " eight nine ten eleven twelve"), (3, None), (3, "")]
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in near_dup.keep_first(make(rows)).collect())
    assert kept.count((5, text)) == 1 and kept.count((-1, text)) == 1 and len(kept) == 7
