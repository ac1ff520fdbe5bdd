"""The corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next one's
docs. All but the last keep the columns of documents; the last returns one row per document with the words the mix takes.

Defined results: a null text counts as empty in every stage; it is toxic to no rule, one of its copies stays, it is near
nothing and holds no benchmark passage. A null id is kept as such. Rows that repeat id and text are copies of one another:
exact dedup leaves one. Of equal texts the row with the largest id stays, of a group of near copies the one with the
smallest; ties go by a print of the text. Empty tables pass through all stages; without labels nothing is toxic, without
benchmark items nothing is contaminated. Other columns are kept, whatever their names, up to the last stage. Ids must be
whole numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fablens.llm.common import table
from fablens.llm.decontamination import drop_contaminated
from fablens.llm.exact_dedup import drop_copies
from fablens.llm.mixing import mix
from fablens.llm.near_dedup import drop_near_copies
from fablens.llm.toxicity import drop_toxic
from fablens.session import stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones, does not reject."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal after lower-casing A-Z."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on shingles of five words."""
    return drop_near_copies(docs, shingle_words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken: the words the mix takes of each document."""
    return mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("source mixing", mixing),
]

# The classifier cannot be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
