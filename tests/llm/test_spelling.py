import random
import zlib
from collections import Counter

from folia.llm import spelling


def apart_by_one(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    """The definition, pair by pair."""
    letters = {chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]}
    count = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c in letters:
                run += c.lower() if c < "[" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                count[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
            run = ""
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if v != w and apart_by_one(v, w)] for w in n}
    top = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: v if v and n[v] >= 2 * n[w] else None for w, v in top.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n}


def test_trie_against_every_pair():
    r = random.Random(3)
    for _ in range(60):
        letters = r.choice(["ab", "abc", "abcdé"])
        words = sorted({"".join(r.choice(letters) for _ in range(r.randint(1, 7))).encode("latin-1") for _ in range(r.randint(1, 50))})
        trie = spelling.Trie(words, [1] * len(words))
        for w in [*words, b"", b"aaaa", b"ababab"]:
            near = trie.neighbours(w)
            assert len(near) == len(set(near))
            assert sorted(near) == [k for k, x in enumerate(words) if x != w and apart_by_one(x, w)]


def test_long_runs_of_one_letter():
    words = [b"a" * 99_999, b"a" * 100_000, b"b" * 5]
    trie = spelling.Trie(words, [1, 1, 1])
    assert [trie.neighbours(w) for w in words] == [[1], [0], []]


def test_whole_result_with_many_shards(spark, make, dirty):
    r = random.Random(7)
    letters = "abcdeÉéß"
    stems = ["".join(r.choice(letters) for _ in range(r.randint(4, 8))) for _ in range(40)]

    def changed(w):
        at = r.randrange(len(w))
        return r.choice([w, w, w, w[:at] + w[at + 1 :], w[:at] + r.choice(letters) + w[at:], w[:at] + r.choice(letters) + w[at + 1 :]])

    rows = [(k, " ".join(changed(r.choice(stems)) for _ in range(120))) for k in range(60)]
    rows += [*dirty, (900, "aaaaa " * 400), (901, "aaaaaa " * 150), (902, "AAAAAAA," * 60), (903, "z" * 5000 + " " + "z" * 5001)] + [(904, "z" * 5000)] * 3
    want = brute(rows)
    assert sum(1 for w in want if w[3]) > 20
    for size in (spelling.SHARD, 300):
        got = [tuple(x[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for x in spelling.variants(make(rows), size).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_counts_in_small_parts(make, dirty, monkeypatch):
    want = {tuple(r) for r in spelling.counted(make(dirty)).collect()}
    monkeypatch.setattr(spelling, "FLUSH", 5)
    assert {tuple(r) for r in spelling.counted(make(dirty)).collect()} == want


def test_empty(make):
    assert spelling.variants(make([(1, None), (2, ""), (3, "ab abcd")])).collect() == []
    assert spelling.variants(make([]).limit(0)).collect() == []
