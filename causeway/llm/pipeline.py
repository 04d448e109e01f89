"""The corpus pipeline: five text operators, each over all that the one before it kept.

toxicity (rejected documents go), line dedup (repeated lines go from the texts), SimHash near-dedup (one document of
each group stays), benchmark decontamination (documents that contain an item go), best-fit packing (one row per piece).
All but the last return the columns of documents, which are all that is read; others, whatever they are called, are
dropped. n_chars is the length of the text as line dedup leaves it.

Defined results, stage by stage: a null or empty text isn't toxic, has one empty line, has fingerprint zero (of all such
documents the one of smallest id stays), contains no item, and is packed as the lone end id. A null doc_id is an id below
all others in line dedup, is no candidate for the id that stays in near-dedup unless its whole group has none, and is
kept like any other elsewhere. Repeated rows are scored each, are one document in line dedup, leave one row in near-dedup.
Texts of any length are read whole. Empty tables give no rows with the same columns; without labels nothing learned is
rejected, without items nothing is contaminated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import decontaminate, line_dedup, packing, simhash, toxicity
from causeway.llm.common import shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Learned scores and packing plans have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score at the threshold or more. Learns from the labels outside the held-out fold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs.select(*COLUMNS), model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that a document of smaller id holds; documents stay, with empty text if all lines go."""
    kept = line_dedup.drop_repeated_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near copies."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontaminate.without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(packing.tokenized_pieces(docs))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written to the shared folder and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    where = f"{shared_dir(spark)}/causeway/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return docs
