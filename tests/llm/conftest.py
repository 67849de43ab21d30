import datetime as dt

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, run long, rank int, core string, host string, n long, text_key string, created timestamp"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) with other columns whose names clash with the operators' own."""

    def docs(rows):
        full = [(i, t, "en", None if k % 3 == 0 else f"s{k % 2}", None if t is None else len(t), "k", k, k, "c", "h", 1, "t", dt.datetime(2024, 1, 1)) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, COLUMNS).repartition(3)

    return docs


@pytest.fixture(scope="session")
def words():
    return "the of and to in that it was for on as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


@pytest.fixture(scope="session")
def dirty(words):
    """Null, empty, white, tied, repeated, very long and non-ASCII texts."""
    import random

    r = random.Random(5)
    para = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, other, passage = para(160), para(220), para(95)
    near = base.split()
    near[3] = "changed"
    near[150] = "altered"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "One"), (8, "Été à Noël, où ça? <|endoftext|> Ünïcode  x"), (9, f"{para(40)} {passage} {para(60)}"), (10, f"{para(70)}\n{passage}\n{para(30)}"), (11, other), (11, other), (12, para(9000)), (13, "a" * 1500), (14, f"{para(30)} password=9f8e7d6c5b4a39281f {para(5)}"), (15, "Licensed under the Apache License, Version 2.0.\n" + para(50)), (None, para(30)), (16, base.upper()), (17, other + " tail"), (18, "x " * 400)]
    return rows
