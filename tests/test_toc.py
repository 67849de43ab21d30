import pytest

from folia.operators import headings, toc, trees


def groups(spark, rows):
    made = [(1, 1, k, kind, level, text, tokens) for k, (kind, text, level, tokens) in enumerate(rows)]
    df = spark.createDataFrame(made, "doc_id long, page_no int, block_no int, kind string, level int, text string, tokens long")
    return [(r.title, r.body, r.tokens) for r in headings.heading_groups(df).orderBy("seq").collect()]


def test_heading_groups(spark):
    rows = [("paragraph", "lead", 0, 10), ("heading", "Terms of", 2, 10), ("heading", "payment", 2, 10), ("paragraph", "body", 0, 40)]
    rows += [("heading", "Note", 3, 2), ("heading", "2. Goods", 2, 10), ("paragraph", "more", 0, 50)]
    assert groups(spark, rows) == [("", ["lead"], 10), ("Terms of payment", ["body", "Note"], 62), ("2. Goods", ["more"], 60)]


def test_headings_that_stay_apart(spark):
    head = lambda t, level=2, n=40: ("heading", t, level, n)
    assert [g[0] for g in groups(spark, [head("A:"), head("B"), head("II. C"), head("D", 3), head(" ".join("w" * 21))])] == ["A:", "B", "II. C", "D"]
    # a small group that stands higher than all since the last one that stays is no part of it
    assert [g[0] for g in groups(spark, [head("A", 3), ("text", "x", 0, 9), head("b", 4, 1), ("text", "y", 0, 1), head("c", 2, 1), ("text", "z", 0, 1), head("d", 3, 1), ("text", "z", 0, 1), head("E", 1)])] == ["A", "c", "E"]


@pytest.mark.parametrize(
    ("formula", "total", "problem"),
    [
        ("=SUM(B{first}:B{last}) * 2", False, None), ("=Z{r}+1", False, "no column Z"), ("=EVIL(B{r})", False, "unknown function"), ("=B7 + 1", False, "not a cell reference"),
        ("=ROUND(B{r}, 2", False, "parentheses don't match"), ('=IF(B{r} > $C${r}, "yes (B7)", 0)', False, None), ("=B{r}", True, "a total can't use {r}"), ("=)B{r}(", False, "parentheses don't match"),
        ("=B{x}", False, "not a cell reference"), ("=1.5%*(2,3)", False, None),
    ],
)
def test_formula_problem(spark, formula, total, problem):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(formula,)], "f string")
    assert df.select(headings.formula_problem(F.col("f"), ["B", "C"], total).alias("p")).collect()[0].p == problem


NODES = "doc_id long, ord int, level int, title string, tokens long"


def nodes_of(spark, rows):
    made = trees.tree(spark.createDataFrame([(d, k, level, title, 5) for d, k, level, title in rows], NODES))
    pages = spark.createDataFrame([(d, k, k + 1, k + 1) for d, k, _, _ in rows], "doc_id long, ord int, page_start int, page_end int")
    return made.join(pages, ["doc_id", "ord"])


def test_view_shows_whole_levels_and_counts_the_rest(spark):
    nodes = toc.below(nodes_of(spark, [(1, 0, 1, "A"), (1, 1, 2, "B"), (1, 2, 3, "C"), (1, 3, 2, "D"), (1, 4, 1, "E")]))
    assert {r.title: r.below for r in nodes.collect()} == {"A": 3, "B": 1, "C": 0, "D": 0, "E": 0}
    shown = lambda budget: {r.title: r.hidden for r in toc.view(nodes, budget).collect()}
    assert shown(0) == {"A": 3, "E": 0} and shown(44) == {"A": 0, "B": 1, "D": 0, "E": 0} and len(shown(1000)) == 5


def test_every_form_of_a_table_of_contents(spark):
    nodes = nodes_of(spark, [(d, k, 1 + k % 2, f"Title {k}") for d in (1, 2) for k in range(6)])
    docs = spark.createDataFrame([(9, d, d, f"f{d}", 6, "word " * 200, False) for d in (1, 2, 3)], "case_id long, doc_id long, created long, file string, page_count int, summary string, expanded boolean")
    got, budget = [], 100_000
    for form in range(4):  # a token less than a form takes gives the next
        r = toc.case_contents(docs, nodes, budget, 0).collect()[0]
        assert r.form == form
        budget = r.tokens - 1
        got.append(r.text)
    assert "[d1.n1] Title 0 (p. 1) +   [d1.n2] Title 2 (p. 3) +" in got[0] and got[0].count("word") == 360 and got[1].count("word") == 360
    assert "(+6 nodes, expand d2)" in got[1] and got[2].count("word") == 120 and "word" not in got[3] and "[d3] f3 (6 p.) (no contents yet)" in got[3]
    whole = toc.case_contents(docs, nodes, 10, 100_000).collect()[0]
    assert whole.form == 0 and "  [d1.n4] Title 1 (p. 2)" in whole.text
    some = toc.case_contents(docs.withColumn("expanded", docs.doc_id == 1), nodes, 10, 40).collect()[0]
    assert some.form == 3 and "[d1.n1] Title 0 (p. 1)   (+1 nodes, expand d1.n1)" in some.text and "d2.n1" not in some.text


def test_walk_opens_reads_and_keeps_budgets(spark):
    rows = [(1, 0, 1, "part one"), (1, 1, 2, "price list"), (1, 2, 3, "price detail"), (1, 3, 1, "price"), (2, 0, 1, "other")]
    nodes = nodes_of(spark, rows)
    queries = spark.createDataFrame([("q", "price"), ("q", "list"), ("none", "zzz")], "query_id string, term string")
    pages = lambda **k: sorted(tuple(r) for r in toc.walk(queries, nodes, **k).collect())
    assert pages() == [("q", 1, 2, 1, 1), ("q", 1, 4, 0, 3)]
    assert pages(hops=0) == [("q", 1, 4, 0, 3)]
    assert pages(per_doc=1) == [("q", 1, 4, 0, 3)] and pages(per_query=1) == [("q", 1, 4, 0, 3)]
    # too big to read: opened instead, as there are matches below
    assert pages(big=0) == [("q", 1, 3, 2, 2), ("q", 1, 4, 0, 3)]

    def said(frontier, big, last):  # a completer's choices as data
        from pyspark.sql import functions as F

        return frontier.withColumn("choice", F.when(F.col("ord") == 0, "open").when(F.col("ord") == 1, "read"))

    assert pages(picker=said) == [("q", 1, 2, 1, 1)]
