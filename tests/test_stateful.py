import datetime as dt
import random

import pytest

from folia.streaming import guard, stateful, streams

BAD = '{\n  "check": "a + b",\n  "expected": -39292632903 + 68499552588 + 617729,\n  "actual": 29207537414\n}'
GOOD = BAD.replace("-39292632903 + 68499552588 + 617729", "29207537414")
TEXTS = [
    (f"Now:\n```json\n{BAD}\n```\nDone.", f"Now:\n```json\n{GOOD}\n```\nDone."), ("```\n[1 + 1]\n```\n", "```\n[2]\n```\n"), (BAD, GOOD), ('```json\n{"a": 1 + 1', '```json\n{"a": 2'),
    ('[\n  {"a": 1 + 1},\n  {"a": 2 + 2}\n]\nend', '[\n  {"a": 2},\n  {"a": 4}\n]\nend'), ('{"s": "a\\" + 1 }", "n": 1 + 1}\nx', '{"s": "a\\" + 1 }", "n": 2}\nx'), ("", ""),
    *[(t, t) for t in ("5 + 3 = 8\n", '```python\n{"b": 1 + 1}\n```\n', "[docs](http://x) and [1 + 2]\n", "```\nkey: 1 + 2\n```\n", "a\x0bb c\r\n")],
    ('```python\nx = 1\n```\n```json\n{"a": 1 + 1}\n```\n', '```python\nx = 1\n```\n```json\n{"a": 2}\n```\n'),
]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 10_000])
def test_guard_wherever_the_text_is_cut(size):
    for text, want in TEXTS:
        held, out = None, []
        for k in range(0, len(text), size):
            g = guard.Guard(held)
            out.append(g.push(text[k : k + size]))
            held = g.state()
        assert "".join(out) + guard.Guard(held).end() == want


def test_prose_is_not_held():
    g = guard.Guard()
    assert g.push("Hello, ") == "Hello, " and g.push("`` x\n") == "`` x\n" and g.push("``") == "" and g.push("x") == "``x"


def batches(spark, tmp_path, schema, parts):
    """A stream of one batch a part."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def T(h, m=0):
    return dt.datetime(2024, 1, 1, h, m)


def test_guarded_stream_over_batches_and_a_lost_end(spark, tmp_path):
    chunk = "text_id string, chunk_no int, text string, last boolean, ts timestamp"
    parts = [[("a", 0, '{"v": 1', False, T(1)), ("b", 0, '[\n"x', False, T(1))], [("a", 1, " + 1}\n", True, T(1, 1))], [("c", 0, "late", True, T(9))]]
    got = streams.to_end(stateful.guarded(batches(spark, tmp_path, chunk, parts))).collect()
    assert sorted(tuple(r) for r in got) == [("a", 0, ""), ("a", 1, '{"v": 2}\n'), ("b", -1, '[\n"x'), ("b", 0, ""), ("c", 0, "late")]


def test_stale_documents_are_reset_once_by_timers(spark, tmp_path):
    news = "doc_id long, ts timestamp, closed boolean"
    parts = [[(1, T(1), False), (2, T(1), False), (3, T(1), True)], [(4, T(5), False)], [(4, T(5, 10), False)], [(1, T(1, 5), False), (4, T(5, 15), False)], [(1, T(6), False), (4, T(5, 20), True)], [(5, T(9), True)]]
    got = streams.to_end(stateful.stale_resets(batches(spark, tmp_path, news, parts))).collect()
    # 1 and 2 time out when 4 comes; 1's row of 1:05 is late by then; 1 comes again at 6 and times out once more
    assert sorted((r.doc_id, r.reset_at) for r in got) == [(1, T(1, 30)), (1, T(6, 30)), (2, T(1, 30))]


def test_states_by_generation_in_any_order(spark, tmp_path):
    r = random.Random(4)
    rows = [(d, gen, part, 3, (d + gen + part) % 4 != 0, T(1, r.randint(0, 59))) for d in range(6) for gen in (1, 2, 3) for part in range(3) if (d, gen, part) != (5, 3, 1)]
    rows += [(7, 1, 0, 2, False, T(1)), (7, 1, 1, 2, False, T(1)), (7, 1, 1, 2, False, T(2))]
    r.shuffle(rows)
    schema = "doc_id long, gen int, part_no int, parts int, ok boolean, ts timestamp"
    seen = streams.to_end(stateful.document_states(batches(spark, tmp_path, schema, [rows[k::4] for k in range(4)]))).collect()
    last = {}
    for x in sorted(seen, key=lambda x: x.version):
        assert x.gen >= last.get(x.doc_id, x).gen  # older work never comes back
        last[x.doc_id] = x
    got = {(x.doc_id, x.gen, x.done, x.failed, x.status) for x in last.values()}
    batch = {(x.doc_id, x.gen, x.done, x.failed, x.status) for x in stateful.document_states_batch(spark.createDataFrame(rows, schema)).collect()}
    assert got == batch and {x[4] for x in got} >= {"ready", "partial", "processing", "error"}
