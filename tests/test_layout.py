import json

from folia.operators import layers, layout as L
from folia.sources.readers import ocr_pages


def quad(x0, y0, x1, y1):
    return [[x0, y0], [x1, y0], [x1, y1], [x0, y1]]


LINES = [
    {"id": 1, "text": "1.2 Scope", "confidence": 0.9, "bounding_box": [[10, 40], [60, 50]], "layout_id": 2},
    {"id": 2, "text": "Contract", "confidence": 0.9, "bounding_box": [[10, 10], [90, 20]], "layout_id": 1},
    {"id": 3, "text": "first line", "confidence": 0.9, "bounding_box": [[10, 60], [90, 68]], "layout_id": None},
    {"id": 4, "text": "second line", "confidence": 0.9, "bounding_box": [[10, 70], [90, 78]], "layout_id": None},
    {"id": 5, "text": "stray", "confidence": 0.9, "bounding_box": [[10, 150], [40, 158]], "layout_id": None},
    {"id": 6, "text": "page 3", "confidence": 0.9, "bounding_box": [[40, 190], [60, 198]], "layout_id": 5},
]
REGIONS = [
    {"id": 1, "class": "doc_title", "confidence": 1, "bounding_box": [[5, 5], [95, 25]]},
    {"id": 2, "class": "paragraph_title", "confidence": 1, "bounding_box": [[5, 35], [95, 55]]},
    {"id": 3, "class": "text", "confidence": 1, "bounding_box": [[5, 58], [95, 80]]},
    {"id": 4, "class": "table", "confidence": 1, "bounding_box": [[5, 90], [95, 120]]},
    {"id": 5, "class": "number", "confidence": 1, "bounding_box": [[30, 185], [70, 199]]},
]
BODY = {"results": LINES, "layout": REGIONS, "reading_order": [2, 1], "tables": [{"layout_id": 4, "html": "<table><tr><td>a</td></tr></table>"}], "formulas": []}


def test_page_from_ocr(spark):
    df = spark.createDataFrame([(1, 3, json.dumps(BODY))], "doc_id long, page_no int, body string")
    got = L.pages(ocr_pages(df)).orderBy("block_no").collect()
    assert [r.kind for r in got] == ["title", "heading", "paragraph", "table", "paragraph", "page_number"]
    assert [r.text for r in got] == ["# Contract", "### 1.2 Scope", "first line second line", "| a |\n| --- |", "stray", "page 3"]
    md = "\n\n".join(r.text for r in got if r.md_start is not None)
    assert all(md[r.md_start : r.md_end] == r.text for r in got if r.md_start is not None)
    assert [(r.line_from, r.line_to) for r in got] == [(1, 1), (2, 2), (3, 4), (None, None), (5, 5), (6, 6)]


def test_order_of_columns_and_moves():
    lines = [{"id": i, "text": t, "quad": quad(*b), "layout_id": i} for i, t, b in ((1, "low", (0, 50, 100, 60)), (2, "high", (0, 0, 100, 10)))]
    regions = [{"id": i, "class": "text", "quad": quad(*b)} for i, b in ((1, (0, 50, 100, 60)), (2, (0, 0, 100, 10)))]
    assert [b["texts"] for b in L.assemble(lines, regions, [1, 2])] == [["high"], ["low"]]


def word(text, *box):
    return layers.boxed(text, box)


def test_text_layer(spark):
    words = [word("Hợp", 0, 0, 20, 10), word("đồng", 22, 0, 45, 10), word("thiếu", 0, 40, 30, 50)]
    lines = [word("Hop dong", 0, 0, 46, 10), word("khac han", 0, 40, 46, 50), word("xa", 0, 80, 46, 90)]
    got = layers.merge_layer(lines, words)
    assert [(x["text"], x["source"], x["ocr"], x["layer"]) for x in got] == [("Hợp đồng", "layer", "Hop dong", None), ("khac han", "ocr", None, "thiếu"), ("xa", "ocr", None, None), ("thiếu", "layer_only", None, None)]
    assert layers.merge_layer([], []) == []
    chars = [(1, i, c, i * 5.0, 0.0, i * 5.0 + 4, 10.0) for i, c in enumerate("ab cd")] + [(1, 9, "e", 90.0, 0.0, 94.0, 10.0), (1, 10, "f", 0.0, 30.0, 4.0, 40.0)]
    df = spark.createDataFrame(chars, "page_no int, char_no int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r.text for r in layers.words_of_chars(df, ["page_no"]).orderBy("word_no").collect()] == ["ab", "cd", "e", "f"]


def test_transcription_finds_its_regions_and_lines():
    assert layers.distribute(["alpha beta gamma", "delta epsilon"], ["alpha beta", "gamma delta epsilon", "something new"]) == [0, 1, None]
    assert layers.distribute([], ["a"]) == [None] and layers.distribute(["a"], []) == []
    lines = [{"text": "Totel amuunt,", "doubtful": False}, {"text": "qqq", "doubtful": False}, {"text": "date", "doubtful": False}]
    got = layers.place(lines, "**Total amount,** due xyz date")
    assert [(x["text"], x["source"]) for x in got] == [("**Total amount,**", "vlm"), ("qqq", "ocr"), ("date", "vlm")]
    assert layers.place(lines, "")[0] == {"text": "Totel amuunt,", "ocr": None, "source": "ocr"}


def test_furniture_and_cards(spark):
    rows = [(1, p, 0, "paragraph", f"Report page {p}") for p in range(1, 5)] + [(1, p, 1, "heading" if p == 1 else "paragraph", f"{'# ' if p == 1 else ''}Body {'abcd'[p - 1]}") for p in range(1, 5)]
    blocks = spark.createDataFrame(rows, "doc_id long, page_no int, block_no int, kind string, text string")
    assert {(r.page_no, r.block_no) for r in L.flag_furniture(blocks).where("furniture").collect()} == {(p, 0) for p in range(1, 5)}
    docs = spark.createDataFrame([(1, "", None), (2, "Given", "s")], "doc_id long, title string, summary string")
    assert {r.doc_id: (r.title, r.summary) for r in L.document_cards(docs, blocks).collect()} == {1: ("Body a", "Report page 1"), 2: ("Given", "s")}


def test_text_choice(spark):
    df = spark.createDataFrame([("v", "l", 0.9, "o"), (" ", "l", 0.9, "o"), (None, "l", 0.1, "o"), (None, "l", 0.1, "")], "vlm string, layer string, layer_score double, ocr string")
    assert [r.text for r in L.choose_text(df).collect()] == ["v", "l", "o", "l"]
    a = spark.createDataFrame([(1, "x"), (1, "y")], "doc_id long, word string")
    b = spark.createDataFrame([(1, "x"), (1, "x"), (1, "z"), (1, "y")], "doc_id long, word string")
    assert L.layer_quality(a, b, ["doc_id"]).collect()[0].overlap == 0.5
