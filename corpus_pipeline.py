"""The corpus pipeline: classify, deduplicate, decontaminate, redact, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is
written to the shared folder and read again as the next stage's docs. Tables other than documents
(labels, benchmark) come from sf_dir.

In every stage: null text counts as empty, an empty table gives an empty one, texts are read whole
whatever their length, rows are judged each where the stage says nothing else, and columns beside
doc_id, text, source, lang and n_chars are handed on unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folia.llm._pieces import vocabulary
from folia.llm._util import stored, table
from folia.llm.decontaminate import keep_clean
from folia.llm.near_dup import keep_first
from folia.llm.packing import pack
from folia.llm.quality import keep_good
from folia.llm.secrets import redact, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical classifier finds neither poor nor toxic.

    Rows that repeat stay or go together; without labels, or labels of one kind only, all stay; null
    sources and languages are sites of their own.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates (five words, similarity of 0.8 or more).

    First is the smallest doc_id. Of rows that share doc_id and text one stays, as of null ids that
    share a text; null, empty and word-free texts of different ids are no copies of each other.
    """
    return keep_first(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; items that are null or word-free have none.

    Repeated rows stay or go together; without benchmark items all stay.
    """
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark; n_chars follows the text.

    No row goes; null text stays null; overlapping secrets become one mark.
    """
    return redact(docs, train())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens.

    Null or empty text is its end id alone; repeated rows are packed each; ties of length go by
    doc_id, start and checksum.
    """
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: Logistic models, minhashes and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
