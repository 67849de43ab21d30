import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from folia.llm import _pieces, packing, token_counts, token_output
from folia.llm._pieces import PieceEncoder, vocabulary

BPE, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def ids(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BPE, WORDS])
def test_pieces_equal_the_library(path):
    r, letters = random.Random(2), "aZ1 \n\t'_s²ªº\xa0中́.,é½ \x1c😀!"
    texts = ["", "  a  b", "x <|endoftext|> y", "it 's don't", " lead", "trail ", "ΑΣ ΑΣ", "a\n\n b  c", "İ ß", "w" * 300] + ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(3000)]
    got = PieceEncoder(path).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == ids(path, texts)


def test_token_output_round_trip(make, dirty):
    got = token_output.read_ids(token_output.write_ids(make(dirty), BPE, shard_tokens=2_000)).collect()
    want = {}
    for (d, _), x in zip(dirty, ids(BPE, [t for _, t in dirty])):
        want.setdefault(d, []).append((len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())))
    assert len(got) == len(dirty)
    for r in got:
        assert (r.n_tokens, r.ids_crc32) in want[r.doc_id]
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == list(np.cumsum([r.n_tokens for r in ordered]) - [r.n_tokens for r in ordered])
    known = [r.doc_id for r in ordered if r.doc_id is not None]
    assert known == sorted(known)


def test_re_pair_random_access():
    r = np.random.default_rng(0)
    docs = [r.integers(0, 6, r.integers(1, 400)).astype(np.uint32) for _ in range(30)] + [np.full(500, 3, np.uint32), np.array([7], np.uint32)]
    blob = token_output.write_shard(list(range(len(docs))), docs, base=50_257)
    shard = token_output.Shard(blob)
    assert all((shard.ids(k) == d).all() for k, d in enumerate(docs))
    assert len(shard.symbols) < 0.55 * sum(map(len, docs)) and len(shard.left) > 0


def test_packing_places_every_id_once(make, dirty):
    rows = packing.pack(make(dirty), BPE, capacity=256).collect()
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for group in by_seq.values():
        group.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in group])
        assert [r.offset for r in group] == list(ends - [r.length for r in group]) and ends[-1] <= 256
    want = {}
    for (d, _), x in zip(dirty, ids(BPE, [t for _, t in dirty])):
        want.setdefault(d, []).append(np.array([*x, 1], "<u4"))
    for d, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, want[d]))
        for p in pieces:
            assert any(p.doc_tokens == len(x) and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in want[d])
    total = sum(len(x) for v in want.values() for x in v)
    assert len(by_seq) <= -(-total // 256) + 2  # next to no padding


def test_fill_is_closest_to_capacity():
    r = random.Random(1)
    for _ in range(60):
        counts = {r.randint(1, 60): r.randint(1, 3) for _ in range(6)}
        seed, best = max(counts), 0
        items = [k for k, n in counts.items() for _ in range(n - (k == seed))]
        for mask in range(1 << len(items)) if len(items) < 14 else ():
            s = seed + sum(x for i, x in enumerate(items) if mask >> i & 1)
            best = max(best, s if s <= 100 else 0)
        uses = packing.fill(counts, 100)
        assert all(counts[k] >= n for k, n in uses.items())
        if len(items) < 14:
            assert sum(k * n for k, n in uses.items()) == best


def test_token_counts_and_cache(make, dirty, tmp_path, spark):
    cache = f"file://{tmp_path}/cache"
    want = sorted((d or -1, len((t or "").encode()), len(x)) for (d, t), x in zip(dirty, ids(WORDS, [t for _, t in dirty])))
    for _ in range(2):
        got = token_counts.count_tokens(make(dirty), WORDS, cache, limit=100).collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 100) for r in got)
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("content").distinct().count()  # the second call finds all and adds none


def test_empty_tables(make, spark, tmp_path):
    none = make([(1, "x")]).where("false")
    assert token_output.read_ids(token_output.write_ids(none, BPE)).count() == 0
    assert packing.pack(none, BPE).count() == 0
    assert token_counts.count_tokens(none, WORDS, f"file://{tmp_path}/c").count() == 0


def test_grammar_runs_until_no_pair_is_frequent():
    from collections import Counter

    from folia.llm import token_output

    r = np.random.default_rng(3)
    for base, n in ((50, 20_000), (65_530, 20_000)):  # the second needs symbols beyond 16 bits
        seq = np.minimum(r.geometric(0.15, n), base - 1).astype(np.uint32)
        last = r.random(n) < 0.01
        last[-1] = True
        out, ends, rules = token_output.compress(seq, last, base)
        pairs = Counter((int(a), int(b)) for a, b, e in zip(out[:-1], out[1:], ends[:-1]) if not e)
        assert rules and max(pairs.values(), default=0) < token_output.LEAST
        assert base + len(rules) > 1 << 16 or base < 100

        def expand(s, base=base, rules=rules):
            return [s] if s < base else [x for p in rules[s - base] for x in expand(p)]

        assert [x for s in out.tolist() for x in expand(s)] == seq.tolist()


@pytest.mark.parametrize("path", [BPE, WORDS])
def test_arrays_of_texts_equal_the_library(path):
    """Texts of an array are cut by their bytes, in one piece or by slices; ids are the library's."""
    r, letters = random.Random(7), "aZst1 \n\n\t'''revlmd_²ªº\xa0 　中́.,é×½٣ \x1c😀!"
    texts = ["", "  a  b", "x <|endoftext|> y", "it 's don't they'll we've 'sup ''s '", " lead", "trail ", "a \n", "\n", " ", "'", "'s", "'r", "b\n\n c\n\nd", "İ ß", "", "w" * 300, "\U0001f600 '", "é's x"]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    want = ids(path, texts)
    for known in (False, True):
        enc = PieceEncoder(path)
        for _ in range(1 + known):
            flat, at = enc.flat(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == want
    part = pa.array(["left out", *texts, "left out"]).slice(1, len(texts))
    flat, at = PieceEncoder(path).flat(part)
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert [x.tolist() for x in PieceEncoder(path).flat(pa.array([], pa.string()))] == [[], [0]] and PieceEncoder(path).flat(pa.array(["", ""]))[1].tolist() == [0, 0, 0]


def test_known_pieces_stay_few(monkeypatch):
    """A full cache becomes the older one; ids stay the same, and a pre-token in use isn't encoded again."""
    monkeypatch.setattr(_pieces, "CACHE", 200)
    enc = PieceEncoder(BPE)
    asked = []
    for k in range(30):
        texts = [f"common words and {' '.join(f'q{k}z{i}' for i in range(40))}", "x" * 60]
        flat, at = enc.flat(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == ids(BPE, texts)
        asked.append(b" common" in enc.known or b"common" in enc.known)
    assert all(asked) and len(enc.known) + len(enc.older) < 600 and b"x" * 60 not in enc.known


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_pydict({"n": list(range(9)), "text": ["", "abc", "d" * 50, "", "é" * 4, "x", "yy", "", "z" * 9]})
    for size in (1, 8, 10, 1000):
        parts = list(_pieces.slices(batch, "text", size))
        assert pa.Table.from_batches(parts).column("n").to_pylist() == list(range(9))
        assert all(p.num_rows == 1 or sum(len(t.encode()) for t in p.column("text").to_pylist()) <= size for p in parts)


def test_re_pair_counts_open_places_only():
    """After a round only places that may hold a frequent pair are counted; the grammar is that of counting all."""
    r = np.random.default_rng(4)
    for base, n in ((40, 6_000), (65_530, 6_000)):
        seq = np.minimum(r.geometric(0.25, n), base - 1).astype(np.uint32)
        last = r.random(n) < 0.01
        last[-1] = True
        chain, rules, counted = token_output._Chain(seq, last), [], []
        while True:
            kept = np.flatnonzero(~chain.gone)
            pairs = Counter((a, b) for a, b, e in zip(chain.seq[kept].tolist(), chain.seq[kept][1:].tolist(), chain.last[kept]) if not e)
            at = np.flatnonzero(chain.open)
            some = Counter(zip(chain.seq[at].tolist(), chain.seq[at + chain.step[at]].tolist()))
            assert {p: k for p, k in pairs.items() if k >= token_output.LEAST} == {p: k for p, k in some.items() if k >= token_output.LEAST}
            counted.append(len(at))
            if not token_output._round(chain, rules, base, token_output.LEAST, token_output.A_ROUND):
                break
        assert len(counted) > 3 and counted[-1] < len(kept)
