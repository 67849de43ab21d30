"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content (runs of ASCII white space become one
space, which this vocabulary's own normaliser does as well) beside a digest of the tokenizer:
its file and library version. Keys found in the cache table take the stored count; each distinct
missing content is encoded once, whole, and appended to the cache.

The digests of all texts are taken in one scan and stored. Only they are grouped; texts move once,
to meet the representative row of their digest, and only those that are missing are encoded. A very
common content is one digest row after the map-side minimum, and its rows look their count up in
salted parts, so copies weigh nothing.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows give a row each, as do
rows that repeat a doc_id with another text; a content stored twice (by two runs at a time) counts
once; texts are encoded whole whatever their length; of the columns only doc_id and text are read,
so others may have any name; an empty table gives an empty result. The cache may be any folder
executors share.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._pieces import encoder, vocabulary
from ._util import delete, looked_up, scratch, shared_dir, stored, table, text_only

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    import tokenizers

    h = hashlib.sha256(f"tokenizers {tokenizers.__version__}\0".encode())
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    return h.hexdigest()


def content_digest(text):
    """Cuts the text's ends and squeezes runs of ASCII white space before hashing."""
    return F.sha2(F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")), 256)


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """The cache's rows of one tokenizer version; a cache that does not exist yet is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache) if fs.exists(path) else spark.createDataFrame([], CACHE_SCHEMA)
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, vocabulary_path: str, cache: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit); appends what it encodes to the cache."""
    with scratch(docs.sparkSession) as result:
        return result(_count_tokens(docs, vocabulary_path, cache, limit), "token-counts")


def _count_tokens(docs: DataFrame, vocabulary_path: str, cache: str, limit: int) -> DataFrame:
    spark = docs.sparkSession
    digest = tokenizer_digest(vocabulary_path)
    rows = text_only(docs)
    text_key = F.xxhash64("text").alias("text_key")
    keyed = stored(rows.select("doc_id", text_key, F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(content_digest(F.col("text"))).alias("content")), "token-digests")
    first = keyed.groupBy("content").agg(F.min(F.struct("doc_id", "text_key")).alias("one"))
    missing = first.join(read_cache(spark, cache, digest), "content", "left_anti").select("content", F.col("one.doc_id").alias("id"), F.col("one.text_key").alias("key"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))
    texts = rows.select("doc_id", "text", text_key).join(missing.hint("shuffle_hash"), same).select("content", "text")

    def encode(batches):
        enc, done = encoder(vocabulary_path), set()  # repeated rows of a representative meet in one task
        for b in batches:
            fresh = [i for i, c in enumerate(b.column("content").to_pylist()) if not (c in done or done.add(c))]
            some = b.take(pa.array(fresh, pa.int64()))
            texts = some.column("text")
            n = [len(x) // 4 for i in range(0, len(texts), 64) for x in enc.encode(texts[i : i + 64].to_pylist())]
            yield pa.RecordBatch.from_arrays([some.column("content"), pa.array([digest] * len(n), pa.string()), pa.array(n, pa.int64())], names=["content", "tokenizer", "n_tokens"])

    texts.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache, digest)
    return looked_up(keyed, "content", counts, by="doc_id").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_digest_cache_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own for each call, deleted after it, so every distinct text is encoded."""
    cache = f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    counts = count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), cache)
    delete(spark, [cache])
    return counts
