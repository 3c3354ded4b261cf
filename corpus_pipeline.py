"""A raw corpus made ready for training: five stages over the documents.

Every stage works on all documents its predecessor kept and reads them from a table, so its
rows come alike each time. All but the last return the columns of documents.

1. toxicity: documents whose score reaches the threshold go, none if the labels lack a class;
2. exact_dedup: of equal texts the one of the largest doc_id stays;
3. near_dedup: of each group linked by five-word shingles the least doc_id stays;
4. secrets: every found secret is replaced by a mark, no document goes;
5. packing: what is left becomes sequences of at most 2048 tokens, one row per piece.

A stage's decision is its operator's, taken over whole texts. Null and empty texts pass the
first stage by the score of an empty text, are equal to one another in the second, link with
nothing in the third, hold no secret, and are packed as an end id alone.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm import exact_dedup, near_dedup, packing, secret_scan, toxicity
from gleanwork.llm.queries import bounded
from gleanwork.llm.storage import shared_folder

#: Score from which a document counts as toxic.
TOXIC = 0.3


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not reject. It learns from the labels of rows that are
    not held out, joined to their texts among `docs`. If those lack a class it has learned
    nothing, and every document stays."""
    labels = bounded(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.filter(~toxicity.held_out()))
    if not model.learned:
        return docs
    return docs.filter(toxicity.score(F.col("text"), model) < TOXIC)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return near_dedup.deduplicate(docs, width=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.without_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("near_dedup", remove_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: A trained classifier and a tokenizer are not SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
