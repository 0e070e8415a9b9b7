"""From raw documents to encoded training data: five stages, each on all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's documents. All but the last return the columns of documents, further
columns of theirs among them.

Rows: a null text counts as empty; the toxicity and personal-data stages keep it as it is. Null
and empty texts are equal texts, so one of them stays after the second stage, that with the
smallest id (a null id only where no other has one); of repeated rows one stays too. Null sources
are a source of their own in the mix, where texts without words are taken once. The toxicity
stage drops a score of exactly 0.5 too. An empty table stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from dyadica.llm import bpe, mixing, neardup, pii, toxicity
from dyadica.llm.common import fold_of, packed, read, unpacked
from dyadica.llm.queries import tokenizer_path
from dyadica.session import delete, ensure_checkpoint_dir, release, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; all others stay as they are.

    The model learns from the labelled documents outside the held-out fifth.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), fold_of("doc_id", 5) != 0)
    return unpacked(toxicity.score_documents(packed(docs, "text"), model, ["_row"]).filter("predicted = 0"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or near-equal texts, the document with the smallest id stays."""
    return neardup.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets; n_chars follows. Every document stays."""
    return pii.redact_documents(docs, pii.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated as often as the mix takes it: not at all, once or twice."""
    mixed = mixing.mix(packed(docs, "text", "source"), ["_row"])
    return unpacked(mixed.filter("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and the digests of the ids and of the text decoded from them."""
    path = tokenizer_path("byte_bpe_50k.json")
    coded = bpe.encode_documents(docs, path, ["doc_id", "source"], decoded=False)
    return coded.select("doc_id", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each),
    ("personal_data", redact),
    ("mix", mix_sources),
    ("encode", encode),
]

# Fitted models and alignments have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote is deleted once the next one is written."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before: list[str] = []
    for name, stage in STAGES:
        mark = written(spark)
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        release(spark, mark)
        delete(spark, before)
        before = [f"{folder}/{name}"]
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
