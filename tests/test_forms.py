from folia.operators.forms import form_placeholders_of, form_regions


def form(name, rows, merged=()):
    """rows: texts, those in a frame with a leading |; merged: (top, left, bottom, right)."""
    out = []
    for r, row in enumerate(rows, 1):
        for c, t in enumerate(row, 1):
            box = next((m for m in merged if m[0] <= r <= m[2] and m[1] <= c <= m[3]), (r, c, r, c))
            out.append((name, r, c, t.lstrip("|"), t.startswith("|"), *box))
    return out


def frame(spark, *forms):
    return spark.createDataFrame([x for f in forms for x in f], "form string, row int, col int, text string, bordered boolean, top int, left int, bottom int, right int")


def test_merged_headers_and_blanks(spark):
    a = form("a", [["LOG", "", "", ""], ["|Day", "|Catch [2]", "|", "|Note"], ["|", "|crates", "|worth", "|"], ["|", "|", "|", "|"], ["|", "|", "|", "|"], ["|Total", "|", "|", "|"], ["Skipper .... [1]", "", "", ""], ["[1] full  name", "[2] landed", "", ""]], [(2, 1, 3, 1), (2, 2, 2, 3), (2, 4, 3, 4)])
    b = form("b", [["only", "text"], ["", ""]])
    c = form("c", [["|x", "|y"], ["|1", "|2"], ["|Cộng", "|"]])
    cells = frame(spark, a, b, c)
    regions = form_regions(cells)
    got = {r.form: tuple(r)[1:] for r in regions.collect()}
    assert got == {"a": ("LOG", 2, 3, 1, 4, 2, 6, 1), "c": (None, 1, 2, 1, 2, 0, 3, 1)}
    assert [tuple(r) for r in form_placeholders_of(cells, regions).collect()] == [("a", 7, 1, "Skipper .... [1]", "full name")]


def test_no_cells(spark):
    assert form_regions(frame(spark)).collect() == []


def test_cells_beside_and_above_the_table(spark):
    """Titles right of the table count, texts below and beside it don't; of several the first by row, then by column."""
    a = form("a", [["", "", "", "far"], ["", "near", "", "x"], ["", "|p", "|q", ""], ["", "|", "|", "note"], ["", "", "", "end"]])
    got = {r.form: tuple(r)[1:] for r in form_regions(frame(spark, a)).collect()}
    assert got == {"a": ("far", 3, 3, 2, 3, 1, None, None)}


def test_no_table_of_forms_is_broadcast(spark):
    """A row a form has no bound; Spark's usual threshold took them to the driver."""
    df = form_regions(frame(spark, *[form(str(k), [["t"], ["|p", "|q"], ["|", "|"]]) for k in range(20)]))
    assert df.count() == 20 and df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan, plan
