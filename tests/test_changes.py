from folia.operators import changes


def test_replace_proposals(spark):
    schema = "doc_id long, page_start int, page_end int, source string, label string"
    old = spark.createDataFrame([(1, 1, 2, "user", "a"), (1, 3, 4, "proposal", "b"), (2, 1, 9, "proposal", "c")], schema)
    new = spark.createDataFrame([(1, 2, 3, "proposal", "x"), (1, 5, 6, "proposal", "y")], schema)
    assert sorted(r.label for r in changes.replace_proposals(old, new).collect()) == ["a", "c", "y"]
