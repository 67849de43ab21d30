import random

import pytest
from pyspark.sql import functions as F

from folia.functions import python_side as P
from folia.functions import runs
from folia.operators import search
from folia.operators.postings import Index


def test_word_similarity_is_the_best_of_all_extents():
    r = random.Random(2)
    for _ in range(200):
        needle, text = ("".join(r.choice("abc ") for _ in range(r.randint(1, 20))) for _ in range(2))
        want, grams = P.trigrams(needle), P.ordered_trigrams(text)
        every = [set(grams[a:z]) for a in range(len(grams)) for z in range(a + 1, len(grams) + 1)]
        assert P.word_similarity(needle, text) == pytest.approx(max((len(want & e) / len(want | e) for e in every), default=0))
    assert P.word_similarity("word", "two words") == pytest.approx(0.8)


def test_cover_density():
    rank = lambda text, *ways: P.cover_density(P.entries_of(text.split(), list(ways)), list(ways))
    assert rank("a b", ["a", "b"]) == pytest.approx(0.1) and rank("a x x b", ["a", "b"]) == pytest.approx(0.1 / 3) and rank("a x", ["a", "b"]) == 0
    assert rank("a a b", ["a", "b"]) == pytest.approx(0.1) and rank("a x b x a", ["a", "b"]) == pytest.approx(0.1)
    assert rank("a x b x c", ["a"], ["b", "c"]) == pytest.approx(0.1 + 0.1 / 2)


def test_headline_has_two_fragments():
    text = " ".join(["w"] * 50 + ["Apache", "License"] + ["v"] * 80 + ["license", "x", "apache"] + ["u"] * 50)
    said = P.headline(text, [["apache", "license"]])
    one, two = said.split(" ... ")
    assert len(one.split()) == len(two.split()) == 30 and "<mark>Apache</mark> <mark>License</mark>" in one and "<mark>license</mark> x <mark>apache</mark>" in two
    assert P.headline(text, [["zzz"]]) == " ".join(["w"] * 10)


def test_line_diff_equals_the_full_table_and_holds_long_texts():
    r = random.Random(5)

    def table(a, b):
        x, y = a.split("\n"), b.split("\n")
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in reversed(range(len(x))):
            for j in reversed(range(len(y))):
                t[i][j] = t[i + 1][j + 1] + 1 if x[i] == y[j] else max(t[i + 1][j], t[i][j + 1])
        out, i, j = [], 0, 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                out, i, j = [*out, (" ", x[i])], i + 1, j + 1
            elif t[i + 1][j] >= t[i][j + 1]:
                out, i = [*out, ("-", x[i])], i + 1
            else:
                out, j = [*out, ("+", y[j])], j + 1
        return out + [("-", s) for s in x[i:]] + [("+", s) for s in y[j:]]

    for _ in range(300):
        a, b = ("\n".join(r.choice("abcd") for _ in range(r.randint(1, 13))) for _ in range(2))
        assert runs.line_diff(a, b) == table(a, b)
    import tracemalloc

    a, b = ("\n".join(str(r.randint(0, 9000)) for _ in range(20_000)) for _ in range(2))
    tracemalloc.start()
    rows = runs.line_diff(a, b)
    assert tracemalloc.get_traced_memory()[1] < 60e6 and [s for m, s in rows if m != "+"] == a.split("\n") and [s for m, s in rows if m != "-"] == b.split("\n")
    tracemalloc.stop()


def test_index_gives_what_a_scan_gives_and_opens_few_buckets(spark, tmp_path):
    r = random.Random(6)
    rows = [(k, " ".join(r.choice("apache license mit the of Ünder creative commons zebra".split()) for _ in range(r.randint(0, 12)))) for k in range(120)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    index = Index(spark, f"file://{tmp_path}/index", ["doc_id"])
    for part in (texts.where("doc_id < 40"), texts.where("doc_id < 90"), texts, texts):
        index.add(part)
    assert index.postings().groupBy("term", "doc_id").count().where("count > 1").count() == 0
    for q in ("apache license", '"apache license" -mit', "zebra or under", "-the", '-the or "creative commons"', "nothing"):
        want = {x.doc_id for x in texts.where(search.matches_text(F.col("text"), q)).collect()}
        assert {x.doc_id for x in index.search(q).collect()} == want, q
    ranked = {x.doc_id: x.rank for x in index.ranks("apache license or zebra").collect()}
    scan = texts.where(search.matches_text(F.col("text"), "apache license or zebra")).select("doc_id", F.round(search.cover_rank(F.col("text"), "apache license or zebra"), 6).alias("rank"))
    assert ranked == {x.doc_id: x.rank for x in scan.collect()}
    near = {x.doc_id for x in index.resembling("apach licence", 0.5).collect()}
    assert near >= {k for k, t in rows if P.word_similarity("apach licence", t) >= 0.5}
    plan = index.of_terms(["zebra"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert index.of_terms(["zebra"]).inputFiles() and len({f.split("bucket=")[1].split("/")[0] for f in index.of_terms(["zebra"]).select("doc_id").inputFiles()}) >= 1
