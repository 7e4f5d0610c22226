"""The corpus pipeline: toxicity, line dedup, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  A
stage's result is written as Parquet in the shared folder and read again as the next
one's documents.  All but the last return the columns of documents.

Null and empty texts pass every stage, very long ones are read whole; rows without a
doc_id are never near another and pass.  Repeated rows of one doc_id are one document to the
line and near-duplicate stages, ties go to the smaller doc_id.  Empty tables give an empty result.
Extra columns, whatever their names (but for those that begin with two underscores), stay up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm import lines, nearmin, packing, secretscan, toxicity
from meshwright.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject; weights are learnt from the labelled ones among them."""
    model = toxicity.learn(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")))
    return docs.where(toxicity.totals_of(F.col("text"), model) < toxicity.THRESHOLD)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand in an earlier place already, exactly or nearly."""
    return lines.dedup_lines(docs, exact=1)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), the one of the smallest doc_id."""
    lost = nearmin.near_duplicates(docs.select("doc_id", "text"), 5, 80).where("not kept").select(F.col("doc_id").alias("__lost")).distinct()
    return docs.join(lost, F.col("doc_id") == F.col("__lost"), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span replaced by a mark."""
    return secretscan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL expresses neither the learnt grammar nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
