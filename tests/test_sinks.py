import hashlib
import hmac
import os

import pytest
from pyspark.sql import functions as F

from folia.plans.checks import FUNCTIONS, CheckError, Scope, Value, compile_check, function, used_fields
from folia.sources import ingest, partitions
from folia.streaming.delivery import Delivery, hmac_sha256


def test_hmac_equals_the_library(spark):
    keys = [b"key", b"k" * 64, b"long" * 40, b"", "Schlüssel".encode()]
    rows = [(k, m) for k in keys for m in (b"", b"what do ya want for nothing?", os.urandom(200))]
    got = spark.createDataFrame([(bytearray(k), bytearray(m)) for k, m in rows], "k binary, m binary").select(hmac_sha256(F.col("k"), F.col("m")).alias("h")).collect()
    assert [r.h for r in got] == [hmac.new(k, m, hashlib.sha256).hexdigest() for k, m in rows]


def test_deliveries_are_retried_given_up_and_never_repeated(spark, tmp_path):
    sink = Delivery(f"file://{tmp_path}/log", "s", lambda id_, body, signature, attempt: 200 if int(id_) <= attempt else 503)
    rows = spark.createDataFrame([(str(k), f"b{k}") for k in (1, 2, 3, 4)] + [("1", "b1")], "id string, body string")
    for _ in range(3):
        sink(rows, 0)
    log = {}
    for r in sink.log(spark).collect():
        log.setdefault(r.id, []).append((r.attempt, r.status))
        assert r.signature == "sha256=" + hmac.new(b"s", f"b{r.id}".encode(), hashlib.sha256).hexdigest()
    assert {k: sorted(v) for k, v in log.items()} == {"1": [(1, 200)], "2": [(1, 503), (2, 200)], "3": [(1, 503), (2, 503), (3, 200)], "4": [(1, 503), (2, 503), (3, 503)]}


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(k, {"n": str(k), "old": "x"}, f"p{k % 3}") for k in range(12)]
    partitions.replace_partitions(spark.createDataFrame(rows, "id int, meta map<string,string>, part string"), path, "part")
    files = lambda: {p: sorted(f for f in os.listdir(f"{path}/part=p{p}") if f.endswith(".parquet")) for p in range(3)}
    before = files()
    assert partitions.set_metadata(spark, path, "part", {"n": {"in": [1, 4]}}, {"new": "y"}, ["old"]) == ["p1"]
    after = files()
    assert before[0] == after[0] and before[2] == after[2] and before[1] != after[1]
    got = {r.id: r.meta for r in spark.read.parquet(path).collect()}
    assert got == {k: {"n": str(k), "new": "y"} if k in (1, 4) else m for k, m, _ in rows}
    assert partitions.set_metadata(spark, path, "part", {"n": "99"}, {"new": "y"}, []) == [] and files() == after


def test_files_are_hashed_in_blocks_and_refused_over_the_cap(spark, tmp_path):
    ingest.register(spark)
    made = {"a.pdf": b"%PDF-1.7 " + os.urandom(3_000_000), "b/c.png": b"\x89PNG" + b"x" * 100, "big": b"z" * 5_000_000, "none": b""}
    for name, data in made.items():
        (tmp_path / "f" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "f" / name).write_bytes(data)
    rows = spark.read.format("folia_files").option("cap", 4_000_000).option("parts", 3).load(str(tmp_path / "f")).collect()
    got = {os.path.relpath(r.path, tmp_path / "f"): (r.length, r.mime, r.sha256, r.refused) for r in rows}
    sha = lambda n: hashlib.sha256(made[n]).hexdigest()
    assert got["a.pdf"] == (3_000_009, "application/pdf", sha("a.pdf"), None) and got["b/c.png"][1:] == ("image/png", sha("b/c.png"), None)
    assert got["big"] == (5_000_000, None, None, "too large") and got["none"] == (0, "application/octet-stream", sha("none"), "empty")
    # a file that grows past the cap while it is read is left at the block that goes over
    assert ingest.balanced([("a", 5), ("b", 4), ("c", 3)], 2)[0].paths == ["a"]


def test_files_as_a_stream_come_once(spark, tmp_path):
    ingest.register(spark)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "one").write_bytes(b"1")

    def run():
        s = spark.readStream.format("folia_files").load(str(tmp_path / "f"))
        s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start().processAllAvailable()
        for q in spark.streams.active:
            q.stop()
        return sorted(os.path.basename(r.path) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["one"]
    (tmp_path / "f" / "two").write_bytes(b"2")
    assert run() == ["one", "two"]


def test_a_function_of_ones_own(spark):
    @function("PERCENT", 2, 2)
    def percent(args, go, scope):
        part, whole = go(args[0]), go(args[1])
        if part.kind != "num" or whole.kind != "num":
            raise CheckError("PERCENT takes numbers")
        return Value("num", F.try_divide(part.col * 100, whole.col))

    scope = Scope({"t": {"a": "number", "b": "number", "s": "string"}}, {"x": ("t", F.col("x"))})
    df = spark.createDataFrame([((("30", "60", "q")),), ((("1", None, "q")),)], "x struct<a:string,b:string,s:string>")
    got = df.select(compile_check("PERCENT(x.a, x.b) = 50", scope)["status"].alias("s")).collect()
    assert [r.s for r in got] == ["pass", "unknown"]
    with pytest.raises(CheckError, match="PERCENT takes 2 arguments"):
        used_fields("PERCENT(x.a)", scope)
    assert "takes numbers" in df.select(compile_check("PERCENT(x.s, x.a) = 1", scope)["missing"].alias("m")).collect()[0].m[0]
    del FUNCTIONS["PERCENT"]
    with pytest.raises(CheckError, match="no function PERCENT"):
        used_fields("PERCENT(x.a, x.b)", scope)
