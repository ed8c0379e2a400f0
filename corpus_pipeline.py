"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a
DataFrame, which is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents. ``run`` applies them to the
documents table. An empty table goes through all stages and gives no rows; texts
of any length are worked on whole; further columns, whatever their names, stay up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from alarmloom.llm.bpe import vocabulary
from alarmloom.llm.common import ensure_checkpoint_dir, remove
from alarmloom.llm.mixing import mixed_documents
from alarmloom.llm.near_copies import drop_near_copies
from alarmloom.llm.packing import first_line, pack_documents, packed_digests
from alarmloom.llm.quality import keep_drawn
from alarmloom.llm.secret_scan import redact

VOCABULARY = "word_bpe_49k.json"
END_ID = 1


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling draws for the quality that ``labels`` calls good.

    Null and empty texts have weight 0 and are drawn like others; equal rows stay or go together.
    """
    return keep_drawn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each set that SimHash links and near copies (five-word similarity of 0.8 or more) join.

    It is the one of the smallest doc_id, null last. Texts without words (null, empty) are one set; of equal rows one stays.
    """
    return drop_near_copies(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with a mark in place of each secret; null and empty texts and equal rows stay as they are."""
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents up to its target, up to three times each.

    A null source is one of its own. A source of no words is left out whole; of others an empty text comes along with those around it.
    """
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a packed sequence of at most 2048 tokens; all but a document's first line bears loss.

    A null or empty text is its end id alone; equal rows are packed each for itself; long texts are cut.
    """
    return packed_digests(pack_documents(docs, vocabulary(VOCABULARY), END_ID, prompt=first_line))


STAGES = [
    ("quality classifier", classify),
    ("simhash near-dedup", deduplicate),
    ("secret scan", mask_secrets),
    ("mix sources", mix_sources),
    ("pack", pack),
]

#: The classifier and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage returns is stored in the shared folder until the next one is.

    The last stage's rows stay there, as the result reads them.
    """
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove(spark, f"{base}/{k - 1}")
    return docs
