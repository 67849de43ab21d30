"""A persisted full-text index: postings of terms with positions, and the trigrams of its terms.

Texts are cut into words once, when they are indexed; a query reads the postings of its own terms. Both tables
are partitioned by a hash of their term (or trigram), so that a scan opens the buckets of the query alone, and
sorted by it inside a file, so that row groups are skipped by their bounds. Indexing is incremental: texts whose
key is known are left out, new ones are added as files. Sizes: a bucket holds the share of the terms
that hash to it; a term that is in most texts makes its bucket large, but is spread over files by text.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import python_side as P
from ..functions import text as T
from ..registry import query
from ..session import load
from ..streaming.streams import shared_folder
from .documents import lines_of
from .search import _QB, _TOK, WORDS, _covers, _line_sql, fuzzy, parse_query, wanted_alternatives

BUCKETS, SPREAD = 16, 4


def _bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


class Index:
    """An index in a folder. keys: the columns that name a text."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path, keys

    def _has(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def add(self, texts: DataFrame) -> None:
        """Indexes the texts whose keys aren't known yet. texts: the keys, and text. A text without words is known, too."""
        if self._has("texts"):
            texts = texts.join(self.spark.read.parquet(f"{self.path}/texts").select(*self.keys), self.keys, "left_anti")
        words = F.posexplode(F.regexp_extract_all(T.unaccent(F.col("text")), F.lit(WORDS))).alias("at", "term")
        rows = texts.select(*self.keys, words).groupBy("term", *self.keys).agg(F.sort_array(F.collect_list("at")).alias("at")).withColumn("bucket", _bucket(F.col("term")))
        # a bucket's rows go to SPREAD files by text, so that no task holds all rows of a frequent term
        salt = F.pmod(F.xxhash64(*self.keys), F.lit(SPREAD))
        rows.repartition("bucket", salt).sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        terms = self.postings().select("term").distinct()
        if self._has("grams"):
            terms = terms.join(self.spark.read.parquet(f"{self.path}/grams").select("term").distinct(), "term", "left_anti")
        padded = F.concat(F.lit("  "), "term", F.lit(" "))
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("term") + 1), lambda i: F.substring(padded, i, F.lit(3))))
        rows = terms.select("term", F.explode(grams).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
        rows.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/grams")
        # last, so that an interrupted run is repeated
        texts.select(*self.keys).write.mode("append").parquet(f"{self.path}/texts")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def _buckets(self, items: list[str]) -> list[int]:
        return sorted({r[0] for r in self.spark.createDataFrame([(i,) for i in items], "t string").select(_bucket(F.col("t"))).collect()})

    def of_terms(self, terms: list[str]) -> DataFrame:
        """The postings of some terms: only their buckets are opened."""
        return self.postings().where(F.col("bucket").isin(self._buckets(terms)) & F.col("term").isin(terms)).dropDuplicates(["term", *self.keys])

    def _gathered(self, q: str) -> DataFrame:
        """A row for each text that has a term of the query: its terms' positions."""
        terms = sorted({w for a in parse_query(q) for _, ws in a for w in ws})
        at = F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("places")
        return self.of_terms(terms).groupBy(*self.keys).agg(at)

    def search(self, q: str) -> DataFrame:
        """Keys of the texts that match. An alternative without a wanted term reads the list of texts as well."""
        ways = parse_query(q)
        hits = self._gathered(q).where(reduce(lambda a, b: a | b, [_holds(a) for a in ways], F.lit(False))).select(*self.keys)
        for alternative in ways:
            if not any(wanted for wanted, _ in alternative):
                known = self.spark.read.parquet(f"{self.path}/texts").select(*self.keys).distinct()
                against = self._gathered(q).where(~_holds(alternative)).select(*self.keys)
                hits = hits.union(known.join(against, self.keys, "left_anti")).distinct()
        return hits

    def ranks(self, q: str) -> DataFrame:
        """Keys and rank of the texts that match, from positions alone."""
        ways = wanted_alternatives(q)
        matched = self._gathered(q).where(reduce(lambda a, b: a | b, [_holds(a) for a in parse_query(q)], F.lit(False)))

        @F.pandas_udf("double")
        def density(terms: pd.Series, places: pd.Series) -> pd.Series:
            entries = (sorted((p, t) for t, ps in zip(ts, at) for p in ps) for ts, at in zip(terms, places))
            return pd.Series([P.cover_density(e, ways) for e in entries], dtype="float64")

        held = matched.select(*self.keys, F.map_keys("places").alias("terms"), F.map_values("places").alias("at"))
        return held.withColumn("rank", density("terms", "at")).select(*self.keys, F.round("rank", 6).alias("rank"))

    def resembling(self, q: str, least: float) -> DataFrame:
        """Keys of the texts that share so many of the query's trigrams that their similarity can reach `least`."""
        grams = sorted(P.trigrams(q))
        table = self.spark.read.parquet(f"{self.path}/grams").where(F.col("bucket").isin(self._buckets(grams)) & F.col("gram").isin(grams))
        shared = table.select("gram", "term").distinct().groupBy("term").agg(F.collect_set("gram").alias("grams"))
        met = self.postings().join(shared, "term").select(*self.keys, F.explode("grams").alias("gram")).distinct()
        return met.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least * len(grams) - 1e-9).select(*self.keys)


def _holds(alternative: list[tuple[bool, list[str]]]) -> Column:
    """Whether a text's positions, a map from term, hold an alternative; a phrase is its words in a row."""

    def term(ws: list[str]) -> Column:
        if len(ws) == 1:
            return F.map_contains_key("places", ws[0])
        first = F.coalesce(F.try_element_at("places", F.lit(ws[0])), F.array().cast("array<int>"))
        rest = [F.coalesce(F.try_element_at("places", F.lit(w)), F.array().cast("array<int>")) for w in ws[1:]]
        return F.exists(first, lambda p: reduce(lambda a, b: a & b, [F.array_contains(r, p + k) for k, r in enumerate(rest, 1)]))

    return reduce(lambda a, b: a & b, [term(ws) if wanted else ~term(ws) for wanted, ws in alternative])


# -- queries ---------------------------------------------------------------------------------

_WEB = 'license -mit or "creative commons" or "the Apache"'


def _indexed(spark: SparkSession, texts: DataFrame, keys: list[str]) -> Index:
    """An index built in two runs: the second is given all texts, and finds those of the first known."""
    index = Index(spark, shared_folder(spark) + "/index", keys)
    index.add(texts.where(F.length("text") < 400))
    index.add(texts)
    return index


@query(
    f"""with t as (select doc_id, {_TOK} as t from documents)
    select doc_id from t where (list_contains(t, 'license') and not list_contains(t, 'mit'))
      or contains(' ' || array_to_string(t, ' ') || ' ', ' creative commons ') or contains(' ' || array_to_string(t, ' ') || ' ', ' the apache ')"""
)
def index_bool_search(spark: SparkSession, d: str) -> DataFrame:
    """T01-T03 from postings: the rows of bool_search_and_or_not."""
    return _indexed(spark, load(spark, d, "documents").select("doc_id", "text"), ["doc_id"]).search(_WEB)


@query(
    f"""with t as (select doc_id, {_TOK} as t from documents), rk as {_covers("documents", "doc_id", "license the")}
    select doc_id, round(rank, 6)::double as rank from t join rk using (doc_id) where list_contains(t, 'license') and list_contains(t, 'the')"""
)
def index_cover_rank(spark: SparkSession, d: str) -> DataFrame:
    """T04 from positions."""
    return _indexed(spark, load(spark, d, "documents").select("doc_id", "text"), ["doc_id"]).ranks("license the")


@query(f"select doc_id, line_no, score from ({_line_sql(_QB, 0.6)})")
def index_word_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The rows of trigram_word_similarity; lines are candidates by their terms' trigrams, then measured."""
    lines = lines_of(load(spark, d, "documents"))
    near = _indexed(spark, lines.withColumnRenamed("line", "text"), ["doc_id", "line_no"]).resembling(_QB, 0.6)
    has = T.contains_fold(F.col("line"), F.lit(_QB))
    scored = lines.join(near, ["doc_id", "line_no"], "left_semi").withColumn("score", F.when(has, F.lit(1.0)).otherwise(fuzzy(F.col("line"), _QB)))
    return scored.where("score >= 0.6").select("doc_id", "line_no", F.round("score", 6).alias("score"))
