"""From raw documents to token ids: five stages, each on what the one before kept.

Each stage is written as Parquet to the shared folder and read again, so a stage is
never recomputed by a later one and survives lost executors; it is deleted once the next is written.

Defined results: null texts count as empty; a text without words has the classifier's bias as
score, so it goes unless the bias alone reaches 0.7; of equal texts one row stays, as of rows
repeated in full; rows without doc_id take part in every stage, are never their group's
smallest id, and all stay in near-dedup, where only ids are dropped; an empty table gives an
empty result; an empty benchmark drops nothing, and without labels every score is 0.5, so
nothing stays. All but the last stage return the columns of their input, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import session
from tessera.llm import classify, decontaminate, exact, sentencepiece_fst, simhash
from tessera.llm.frames import table
from tessera.llm.queries import MODEL_PATH


def _own(name: str) -> str:
    """A column of a stage that can't be one of the table's."""
    return f"__pipeline_{name}"


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.7) go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = classify.train(docs, labels, "quality", classify.QUALITY, keep=~classify.held_out("doc_id", 4, 2))
    scored = classify.score(docs, model, names=(_own("score"), _own("predicted")))
    return scored.filter(F.col(_own("predicted")) == 1).select(*_columns(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the longest and then first document stays; of rows alike in doc_id
    and text, one."""
    return exact.without_copies(docs, single=True).select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash, the one with the smallest id stays."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = decontaminate.flagged(docs, table(spark, sf_dir, "benchmark"), name=_own("leaks"))
    return found.filter(F.size(_own("leaks")) == 0).select(*_columns(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, decoded again to see that nothing is lost."""
    return sentencepiece_fst.encode(docs.select("doc_id", "text"), MODEL_PATH, check=True).select("doc_id", "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("sentencepiece", tokens),
]

#: Trained classifiers and token ids aren't expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{session.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            session.deleted(spark, f"{folder}/{k - 1}")  # nothing reads it any more
    return docs
