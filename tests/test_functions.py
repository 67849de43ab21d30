import math

import random

import pytest
from pyspark.sql import functions as F

from folia.functions import dates, runs, text
from folia.functions import python_side as P
from folia.operators import meta, search, sequences, trees
from folia.sources import readers


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).collect()[0].x


@pytest.mark.parametrize("s,want", [("UBND XÃ NHA BÍCH", "ubnd xa nha bich"), ("Đồng Nai", "dong nai"), ("Độc lập - Tự do", "doc lap - tu do"), ("ß ø ł", "ß ø ł")])
def test_unaccent(spark, s, want):
    assert one(spark, s, text.unaccent) == want == P.fold(s)


@pytest.mark.parametrize("a,b,same", [("15.000.000.000", "15000000000", True), ("0101-234-567", "0101234567", True), ("QSDĐ thửa 112", "qsdd thua 112", True), ("Công ty A", "cong ty a.", True), ("12", "13", False), ("", "x", False)])
def test_value_key(spark, a, b, same):
    assert (one(spark, a, text.value_key) == one(spark, b, text.value_key)) is same


@pytest.mark.parametrize("s,want", [("1.234,5", 1234.5), ("1,234.5", 1234.5), ("15.000", 15000.0), ("12,5", 12.5), ("01/02/2025", None), ("15 000 000 đ", 15e6), ("-2.000 VND", -2000.0), ("", None), ("abc", None), ("15.000.000", 15e6), ("12.50", 12.5), ("1,234", 1234.0)])
def test_parse_number(spark, s, want):
    assert one(spark, s, text.parse_number) == want


def test_similarity_and_estimates(spark):
    assert one(spark, "Bích", lambda c: text.similarity(c, F.lit("bich"))) == 1.0
    assert one(spark, "abcd", lambda c: text.similarity(c, F.lit("abxd"))) == 0.75
    assert [one(spark, s, text.estimate_tokens) for s in ("", "ab", "abc")] == [0, 1, 2]
    assert one(spark, "abcdef", lambda c: text.truncate(c, 3)) == "abc…"
    assert one(spark, "Trang 3 / 10", text.furniture_key) == "trang # / #"
    assert one(spark, "doc:x:p3:l8-l10", lambda c: text.parse_citation(c)) == ("x", 3, 8, 10)
    assert one(spark, "doc:x:p3:l9", lambda c: text.parse_citation(c)) == ("x", 3, 9, 9)
    assert one(spark, "doc:x:3", lambda c: text.parse_citation(c)) is None


def test_dates(spark):
    for s in ("2025-02-01", "01/02/2025", "1/2/2025", "01-02-2025", "01.02.2025", "2025/02/01"):
        assert str(one(spark, s, dates.parse_date)) == "2025-02-01"
    assert one(spark, "31/02/2025", dates.parse_date) is None
    assert str(one(spark, "2026-01-31", lambda c: dates.add_overflowing(c.cast("date"), F.lit(1), "month"))) == "2026-03-03"


@pytest.mark.parametrize("e,want", [("1+2*3", "7"), ("2^3^2", "512"), ("-2^2", "-4"), ("0.1+0.2", "0.3"), ("10%3", "1"), ("-7%3", "-1"), ("round(2.5)", "3"), ("round(-2.5)", "-3"), ("round(1234.567,-2)", "1200"), ("round(1.005,2)", "1.01"), ("abs(-3)", "3"), ("floor(-1.5)", "-2"), ("ceil(1.2)", "2"), ("min(3,1,2)", "1"), ("avg(1,2)", "1.5"), ("sum(0.1,0.2)", "0.3"), ("1/8", "0.125"), ("2^-1", "0.5"), ("(1+2)*3", "9"), ("1/3", "0.3333333333"), ("2/3", "0.6666666667"), ("2.5e2 - 1", "249"), ("7e-1", "0.7"), ("1_500", "1500"), ("10^20+1", "100000000000000000001")])
def test_calculator(e, want):
    assert P.render(P.calculate(e)) == want


@pytest.mark.parametrize("e", ["", "1/0", "1%0", "(1", "1)", "2+", "foo(1)", "1 2", "2^0.5", "2^100000", "abs(1,2)", "$", "round(1,0.5)", "0^-1", "9" * 3000])
def test_calculator_errors(e):
    with pytest.raises(P.CalcError):
        P.calculate(e)


def test_json():
    assert P.json_problem('{"a": [1, 2]}') is None and P.json_problem('{"a":\n 1,}')[0] == 2 and P.json_problem("NaN") is not None
    assert P.first_json('<think>{"no": 1}</think> x {"a": [1]} y') == '{"a": [1]}' and P.first_json("none") is None
    assert P.repair_json('{"a": 1 + 2, "b": "1 + 2", "c": [2*3, -4]}') == '{"a": 3, "b": "1 + 2", "c": [6, -4]}'


def test_diff_and_alignment():
    assert runs.line_diff("a\nb", "a\nc\nb") == [(" ", "a"), ("+", "c"), (" ", "b")]
    assert P.align("a b c".split(), "a x b c".split()) == [(0, 0, 0.0), (1, 2, 0.0), (2, 3, 0.0)]
    assert [(i, j) for i, j, c in P.align("total amount due".split(), "totel amount".split()) if c < 0.5] == [(0, 0), (1, 1)]
    assert P.edits("kitten", ["sitting", "", "kitten"]).tolist() == [3, 6, 0] and P.edits("", ["ab", ""]).tolist() == [2, 0] and P.alike("", "") == 1.0
    assert P.align(["a"] * 10, ["b"] * 10, most=50) is None


def test_hash_embedding():
    a, b, c = (P.hash_embedding(s) for s in ("River Boats at DAWN", "river boats at dawn x", "market news of the day"))
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    assert a == b and dot(a, a) == pytest.approx(1) and dot(a, c) < 0.5 and P.fnv1a(b"") == 0xCBF29CE484222325 and P.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert P.fnv1a(b"a", 32) == 0xE40C292C and P.hash_embedding("x y ,") == [0.0] * 256
    one = P.hash_embedding("boat boat boat sea")
    h = P.fnv1a(b"boat")
    assert one[h % 256] * (-1 if h >> 63 else 1) > 0 and len([v for v in one if v]) == 4
    weights = sorted({round(abs(v) / max(map(abs, one)), 6) for v in one if v})
    assert weights == [round(1 / (1 + math.log(3)), 6), 1.0]


def pages(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "doc_id long, page_no int, label string, confidence double, first_page boolean")


def test_page_groups(spark):
    got = sequences.group_pages(pages(spark, [(1, "hop_dong", 0.9, True), (2, "hop_dong", 0.8, False), (3, "hop_dong", 0.9, True), (4, "hoa_don", 0.95, True)]), least=0.5).orderBy("page_start").collect()
    assert [(r.page_start, r.page_end, r.label) for r in got] == [(1, 2, "hop_dong"), (3, 3, "hop_dong"), (4, 4, "hoa_don")]
    got = sequences.group_pages(pages(spark, [(1, "a", 0.2, False), (2, "a", 0.9, False), (5, "b", 0.9, False)]), least=0.5).orderBy("page_start").collect()
    assert [(r.page_start, r.page_end, r.label, r.proposed_label) for r in got] == [(1, 2, "unknown", "a"), (5, 5, "b", None)]
    assert sequences.group_pages(pages(spark, [(1, "", 0.0, False), (2, None, 0.0, True)])).count() == 0


def test_cover_is_exact(spark):
    r = random.Random(4)
    for _ in range(3):
        cuts = sorted(r.sample(range(1, 31), 6))
        spans = [(1, a, b, "x") for a, b in zip(cuts[::2], cuts[1::2])]
        spans = [s for i, s in enumerate(spans) if i == 0 or s[1] > spans[i - 1][2]]
        df = spark.createDataFrame(spans, "doc_id long, page_start int, page_end int, label string")
        counts = spark.createDataFrame([(1, 30), (2, 5)], "doc_id long, page_count int")
        skipped = spark.createDataFrame([(1, p) for p in r.sample(range(1, 31), 5)], "doc_id long, page_no int")
        full = sequences.cover(df, counts, skipped)
        assert sequences.cover_errors(full, counts.where("doc_id = 1")).count() == 0 and full.where("doc_id = 2").count() == 0


def test_greedy_overlaps_against_a_loop(spark):
    r = random.Random(9)
    rows = [(d, i, a, a + r.randint(0, 6), r.random()) for d in range(3) for i, a in enumerate(r.randint(1, 40) for _ in range(15))]
    df = spark.createDataFrame(rows, "doc_id long, id int, page_start int, page_end int, confidence double")
    got = {(x.doc_id, x.id) for x in sequences.drop_overlaps(df, [F.desc("confidence"), F.asc("id")]).collect()}
    want, held = set(), {}
    for d, i, a, b, _ in sorted(rows, key=lambda x: (x[0], -x[4], x[1])):
        if all(b < p or a > q for p, q in held.get(d, [])):
            held.setdefault(d, []).append((a, b))
            want.add((d, i))
    assert got == want


def test_cut_hints(spark):
    rows = [(1, 1, "Trang 1/2\na", 10.0, 20.0), (1, 2, "x\nTrang 2/2", 10.0, 20.0), (1, 3, "Trang 1/3\nb", 10.0, 20.0), (1, 4, "", 10.0, 20.0), (1, 5, "c", 20.0, 10.0), (1, 6, "d", 30.0, 10.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, text string, width double, height double")
    assert {r.page_no: list(r.hints) for r in sequences.cut_hints(df).collect()} == {3: ["number_restarts"], 5: ["after_blank", "orientation"], 6: ["size"]}


def test_metadata_filters(spark):
    df = spark.createDataFrame([(1, {"n": "123", "s": "Ab%c", "d": "2024-05-01T10:00"}), (2, {"n": "0123"}), (3, {})], "id int, m map<string,string>")
    ids = lambda spec, schema=None: [r.id for r in df.where(meta.compile_filter(F.col("m"), spec, schema)).orderBy("id").collect()]
    assert ids({"n": "123"}) == ids({"n": 123}) == [1] and ids({"n": {"ne": 123}}) == [2, 3] and ids({"n": {"in": [123, "0123"]}}) == [1, 2]
    assert ids({"s": {"prefix": "Ab%"}}) == [1] and ids({"s": {"prefix": "A_"}}) == [] and ids({"n": {"exists": False}}) == [3]
    assert ids({"n": {"gt": 100, "lte": 123}}) == [1, 2] and ids({"d": {"gte": "2024-05-01", "lt": "2024-05-02"}}) == [1] and ids({"n": {"lt": "1"}}, {"n": "string"}) == [2]
    for bad in ({"a b": 1}, {"n": {"like": "x"}}, {"n": {"in": 3}}):
        with pytest.raises(meta.FilterError):
            meta.compile_filter(F.col("m"), bad)


def test_query_language():
    assert search.parse_query('a "b c" -d or "x"') == [[(True, ["a"]), (True, ["b", "c"]), (False, ["d"])], [(True, ["x"])]]
    ways = [["a", "b"]]
    assert P.cover_density(P.entries_of("a x b a".split(), ways), ways) == pytest.approx(0.1 / 2 + 0.1)
    assert P.word_similarity("word", "two words") == pytest.approx(0.8) and P.word_similarity("apache", "nothing") == 0


def test_sections(spark):
    rows = [(1, 1, 0, "title", "# A"), (1, 1, 1, "paragraph", "x" * 60), (1, 1, 2, "paragraph", "y" * 60), (1, 2, 0, "heading", "## B"), (1, 2, 1, "table", "|h|\n|-|\n" + "\n".join(f"|{'r' * 30}{i}|" for i in range(6))), (1, 2, 2, "footer", "f")]
    got = trees.sections(spark.createDataFrame(rows, trees.BLOCKS), 30).orderBy("seq").collect()
    assert [r.kind for r in got][:2] == ["text", "text"] and got[0].heading_path == ["A"] and got[-1].heading_path == ["A", "B"]
    tables = [r.text for r in got if r.kind == "table"]
    assert len(tables) > 1 and all("|h|\n|-|" in t for t in tables) and sum(t.count("rrr") for t in tables) >= 6


def test_deepest_and_outline(spark):
    nodes = spark.createDataFrame([(1, 0, 1, "A", 5), (1, 1, 2, "B", 3), (1, 2, 3, "C", 2), (1, 3, 2, "D", 1), (1, 4, 1, "E", 4)], "doc_id long, ord int, level int, title string, tokens long")
    t = trees.tree(nodes)
    assert {(r.ord, r.parent, r.depth, r.subtree_tokens, r.short_id) for r in t.collect()} == {(0, -1, 1, 11, "n1"), (1, 0, 2, 5, "n3"), (2, 1, 3, 2, "n5"), (3, 0, 2, 1, "n4"), (4, -1, 1, 4, "n2")}
    assert trees.table_of_contents(t, 10).collect()[0].toc == "n1 A\n  n3 B\n  n4 D\nn2 E"
    spans = spark.createDataFrame([(1, 0, 1, 1, 9), (1, 1, 2, 2, 4), (1, 2, 2, 4, 6)], "doc_id long, ord int, depth int, page_start int, page_end int")
    at = spark.createDataFrame([(1, 1), (1, 4), (1, 5)], "doc_id long, page_no int")
    assert {r.page_no: r.node for r in trees.deepest(spans, at).collect()} == {1: 0, 4: 1, 5: 2}


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 <pdfaid:part>2</pdfaid:part><pdfaid:conformance>U</pdfaid:conformance>")
    (tmp_path / "big.bin").write_bytes(b"x" * 5000)
    got = readers.files(spark, str(tmp_path), most_bytes=1000).select("mime", "length", readers.pdf_conformance(F.col("content")).alias("c")).collect()
    assert len(got) == 1 and got[0].mime == "application/pdf" and tuple(got[0].c) == (2, "u", True)
    assert readers.table_markdown('<table><tr><th colspan="2">H|</th></tr><tr><td>a</td><td>b<br>c</td></tr></table>') == "| H\\| |  |\n| --- | --- |\n| a | b c |"
    assert [k for k, _ in readers.markdown_regions("# T\n\ntext\nmore\n\n|a|b|\n|-|-|\n\n$$x$$\n![f](u)\nĐiều 1. X")] == ["title", "paragraph", "table", "formula", "figure", "heading"]


@pytest.mark.parametrize("e", ["1.234.567", "1 234", "2e1001", "1/(2-2)", "foo(1)", "(1"])
def test_calculator_refuses(e):
    with pytest.raises(P.CalcError):
        P.calculate(e)


def test_exact_or_rounded():
    assert P.ends(P.calculate("3/40")) and not P.ends(P.calculate("1/7")) and P.render(P.calculate("-1/6"), 3) == "-0.167"


def test_region_classes():
    from folia.operators.layout import CLASSES

    assert (CLASSES["seal"], CLASSES["chart"], CLASSES["footnote"], CLASSES["table_title"], CLASSES.get("other", "unknown")) == ("figure", "figure", "footnote", "caption", "unknown")


def test_lines_that_begin_with_a_wanted_word_are_not_left_out(spark):
    """Seven of the query's seventeen trigrams, the first of them at the start of the line."""
    lines = spark.createDataFrame([(1, 1, "MIT tex"), (1, 2, "(mit tex"), (1, 3, "a mit tex"), (1, 4, "mit te")], "doc_id long, line_no long, line string")
    got = {r.line_no: r.score for r in search.line_hits(lines, "MIT Licence text", 0.4).collect()}
    assert got == {k: 7 / 17 for k in (1, 2, 3)}


def test_similarities_of_many_texts_equal_one_at_a_time():
    rng = random.Random(3)
    words = ["a", "ab", "mit", "licence", "license", "text", "tex", "li", "té", "x", "licenc", "mitt", "ngữ"]
    for _ in range(300):
        texts = [" ".join(rng.choice(words[: rng.randint(1, 13)]) for _ in range(rng.randint(0, rng.choice((1, 8, 30, 300))))) for _ in range(3)]
        q, least = rng.choice(("MIT Licence text", "license", "a", "ab li")), rng.choice((0.2, 0.4, 0.5, 0.6, 1.0))
        for t, got in zip(texts, P.word_similarities(q, texts, least), strict=True):
            want = P.word_similarity(q, t)
            assert got == want if want >= least else got in (0.0, want)
    assert P.word_similarities("MIT", ["", "x"], 0.5) == [0.0, 0.0]


def test_long_texts_that_are_unlike_are_left_out_at_once():
    """Many of the query's trigrams, but never enough of them in one extent."""
    texts = [" ".join(f"{'li mi te ice nce'.split()[k % 5]}{k}" for k in range(2000)), "mit licence"]
    assert P.maybe_similar("MIT Licence text", texts, 0.5).tolist() == [False, True]


def test_narrow_alignment_equals_the_whole_table():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    costs = P.word_costs(words, words)
    assert all(P.word_cost(a, b) == costs[i, j] for i, a in enumerate(words) for j, b in enumerate(words))
    narrow = 0
    for _ in range(60):
        a = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            i = rng.randrange(len(b))
            b[i : i + rng.randint(0, 2)] = [rng.choice(words) for _ in range(rng.randint(0, 2))]
        b += ["ωω"] * rng.randint(0, 2)
        whole = P.align(a, b)  # too short for the narrow way
        for around in (2.0, 8.0, 1000.0):
            got = P.near_align(a, b, 0.7, around)
            assert got == whole or got is None and around < 1000
            narrow += got is not None
    assert narrow > 60
