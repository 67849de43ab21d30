"""Signed deliveries: keyed digests as column expressions, and a sink that logs its attempts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..session import load
from .streams import as_stream, shared_folder

BLOCK, INNER, OUTER = 64, 0x36, 0x5C  # fixed values of the keyed digest


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC-SHA256 in lower-case hex of two binary columns (text counts as UTF-8); null where either is."""
    key, message = key.cast("binary"), message.cast("binary")
    short = F.when(F.length(key) > BLOCK, F.sha2(key, 256)).otherwise(F.lower(F.hex(key)))
    padded = F.rpad(short, 2 * BLOCK, "0")

    def mixed(byte: int) -> Column:
        at = lambda i: F.conv(F.substring(padded, 2 * i - 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(byte))
        return F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(BLOCK)), lambda i: F.lpad(F.hex(at(i)), 2, "0")), ""))

    return F.sha2(F.concat(mixed(OUTER), F.unhex(F.sha2(F.concat(mixed(INNER), message), 256))), 256)


Send = Callable[[str, str, str, int], int]
LOG = "id string, attempt int, status int, signature string"


class Delivery:
    """Sends rows (id, body) once each, with a signature, and keeps a log of attempts in a folder.

    send(id, body, signature, attempt) runs in the tasks and gives a status; under 300 it is delivered, else it
    is tried again, `most` times in all. Every attempt is one write of the log, so what a batch has sent is known
    when it is run again: what the log calls delivered or given up isn't sent once more. Should a task be lost before
    its part of the log is kept, its rows are sent again (at least once).
    """

    def __init__(self, path: str, secret: str, send: Send, most: int = 3) -> None:
        self.path, self.secret, self.send, self.most = path, secret, send, most

    def log(self, spark: SparkSession) -> DataFrame:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        return spark.read.schema(LOG).parquet(self.path) if there else spark.createDataFrame([], LOG)

    def __call__(self, rows: DataFrame, batch_id: int | None = None) -> None:
        spark, send = rows.sparkSession, self.send
        signed = rows.dropDuplicates(["id"]).select("id", "body", F.concat(F.lit("sha256="), hmac_sha256(F.lit(self.secret), F.col("body"))).alias("signature"))

        def attempts(batches):
            for b in batches:
                columns = [b.column(c).to_pylist() for c in ("id", "body", "signature", "attempt")]
                status = [send(*r) for r in zip(*columns)]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("attempt"), pa.array(status, pa.int32()), b.column("signature")], names=["id", "attempt", "status", "signature"])

        for _ in range(self.most):
            tried = self.log(spark).groupBy("id").agg(F.max("attempt").alias("tried"), F.min("status").alias("best"))
            open_ = signed.join(tried, "id", "left").where(f"tried is null or (best >= 300 and tried < {self.most})")
            due = open_.select("id", "body", "signature", (F.coalesce("tried", F.lit(0)) + 1).alias("attempt"))
            due.mapInArrow(attempts, LOG).write.mode("append").parquet(self.path)
            if not self.log(spark).join(signed, "id", "left_semi").groupBy("id").agg(F.min("status").alias("best"), F.max("attempt").alias("n")).where(f"best >= 300 and n < {self.most}").limit(1).count():
                return


_PADS = "list_transform(range(1, 65), lambda i: printf('%02x', xor(case when i <= length(k) then ascii(k[i]) else 0 end, {0})::integer))"
_HMAC = "sha256(unhex(array_to_string(" + _PADS.format(0x5C) + ", '')) || unhex(sha256(unhex(array_to_string(" + _PADS.format(0x36) + ", '')) || {0}::blob)))"


@query(f"with e as (select event_id, 'key-' || user_id as k, props from events) select event_id, {_HMAC.format('props')} as mac, sha1(props) as sha1 from e")
def event_digests(spark: SparkSession, d: str) -> DataFrame:
    """A key for each user."""
    key = F.concat(F.lit("key-"), F.col("user_id").cast("string"))
    return load(spark, d, "events").select("event_id", hmac_sha256(key, F.col("props")).alias("mac"), F.sha1(F.col("props").cast("binary")).alias("sha1"))


def _refusing(id_: str, body: str, signature: str, attempt: int) -> int:
    """A receiver that refuses every third row once, and every seventh always."""
    n = int(id_)
    return 500 if n % 7 == 0 or (n % 3 == 0 and attempt == 1) else 200


@query(
    f"""with e as (select event_id, 'secret' as k, props from events where event_type = 'purchase')
    select event_id::varchar as id, case when event_id % 7 = 0 then 3 when event_id % 3 = 0 then 2 else 1 end::int as attempts, event_id % 7 <> 0 as delivered,
      'sha256=' || {_HMAC.format('props')} as signature from e"""
)
def signed_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Purchases as a stream, delivered with a signature; the stream's batch is run twice, and sends nothing anew."""
    folder = shared_folder(spark)
    sink = Delivery(f"{folder}/log", "secret", _refusing)
    rows = as_stream(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").cast("string").alias("id"), F.col("props").alias("body"))

    def twice(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id)
        sink(batch, batch_id)

    rows.writeStream.foreachBatch(twice).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    log = sink.log(spark).groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("attempts"), (F.min("status") < 300).alias("delivered"), F.first("signature").alias("signature"))
    return log.select("id", "attempts", "delivered", "signature")
