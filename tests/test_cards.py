import pytest
from pyspark.sql import functions as F

from folia.operators import cards
from folia.plans.case_types import ORDER_CASE, CaseType, CaseTypeError

MARKS = "doc_id long, page_no int, origin string, ord int, level int, title string, tokens long"


def test_outline_of_spans_bookmarks_and_headings(spark):
    rows = [
        (1, 1, "lead", 0, 1, "Page 1", 7), (1, 1, "layout", 1, 2, "Intro", 3), (1, 2, "bookmark", 0, 1, "Terms", 0), (1, 2, "layout", 1, 1, " terms", 5), (1, 2, "layout", 2, 1, "Price", 4),
        (1, 3, "lead", 0, 1, "Page 3", 6), (1, 3, "doctype", 0, 1, "Annex", 0), (1, 3, "layout", 5, 1, "Table", 2),
    ]
    got = [(r.ord, r.level, r.title, r.origin, r.page_start, r.tokens) for r in cards.outline(spark.createDataFrame(rows, MARKS)).orderBy("ord").collect()]
    # the document has a span, so all else stands a level lower; the annex closes the bookmark
    assert got == [(1, 2, "Page 1", "layout", 1, 7), (2, 3, "Intro", "layout", 1, 3), (3, 2, "Terms", "bookmark", 2, 5), (4, 3, "Price", "layout", 2, 4), (5, 1, "Annex", "doctype", 3, 6), (6, 2, "Table", "layout", 3, 2)]


def test_places_of_citations_and_texts(spark):
    lines = spark.createDataFrame([(1, 2, k, f"Line {k} Độc lập", 10.0, 0.0, 20.0, 5.0, dpi) for k, dpi in ((1, 144.0), (2, 144.0), (3, None))], "doc_id long, page_no int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, dpi double")
    cites = spark.createDataFrame([("doc:1:p2:l2-l3",), ("doc:1:p2:l9",), ("doc:x",)], "cite string")
    assert sorted((r.cite, r.line_no, r.x1_pt) for r in cards.locate_citations(cites, lines).collect()) == [("doc:1:p2:l2-l3", 2, 10.0), ("doc:1:p2:l2-l3", 3, 0.0)]
    wanted = spark.createDataFrame([(1, None, "DOC LAP"), (1, 1, "line"), (1, 2, "line 3"), (1, None, " ")], "doc_id long, page_no int, wanted string")
    assert sorted((r.wanted, r.line_no) for r in cards.locate_text(wanted, lines).collect()) == [("DOC LAP", 1), ("DOC LAP", 2), ("DOC LAP", 3), ("line 3", 3)]


def test_summaries_and_values(spark):
    df = spark.createDataFrame([(["", "a b", " ", "c d e", "f"],)], "p array<string>")
    assert df.select(cards.joined_summary(F.col("p"), 2).alias("s")).collect()[0].s == "a b; c d"
    first = lambda t: spark.createDataFrame([(t,)], "t string").select(cards.first_line(F.col("t")).alias("x")).collect()[0].x
    assert first("\n![x](y)\n## **Big**  title\nmore") == "Big title" and first("") == ""
    got = [r.v for r in spark.createDataFrame([(x,) for x in ('"a"', "3.0", "2.50", "true", "null", "12345678901")], "j string").select(cards.value_text(F.col("j")).alias("v")).collect()]
    assert got == ["a", "3", "2.5", "true", None, "12345678901"]


def test_large_and_small_numbers_have_no_exponent(spark):
    want = {"12500002.5": "12500002.5", "-12500002.5": "-12500002.5", "1.5e7": "15000000", "2.5e-7": "0.00000025", "0.001": "0.001", "10000000.0": "10000000", "123456789012.25": "123456789012.25", "1e40": "1" + "0" * 40, "-0.5": "-0.5", "0": "0"}
    got = {r.j: r.v for r in spark.createDataFrame([(x,) for x in want], "j string").select("j", cards.value_text(F.col("j")).alias("v")).collect()}
    assert got == want


@pytest.mark.parametrize(
    ("change", "fault"),
    [(('"name": "orders"', '"name": "Or ders"'), "name:"), (('"upper_trim"', '"odd"'), "no form"), (('"^[1-5]-[A-Z ]+$"', '"["'), "code:"), (('[{"name": "F"}, {"name": "O"}]', '[{"name": "F"}]'), "opens_with: no label 'O'"), (('"type": "date"', '"type": "x"'), "no type"), (("{", "["), "not JSON")],
)
def test_faults_of_a_case_type_are_named(change, fault):
    with pytest.raises(CaseTypeError, match=fault.replace("(", r"\(")):
        CaseType.from_json(ORDER_CASE.replace(*change, 1))
