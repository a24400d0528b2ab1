"""The corpus pipeline: toxicity, line dedup, near-duplicate removal, source mixing and packing, each on all that the last one kept.

STAGES lists (name, function) pairs. A function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs; all but the last return the columns of `documents`.

What the stages do with odd rows: null and empty texts are scored like texts without words, have no lines, link with nothing, are taken 0 times
by the mix and so end there; null ids, sources and languages are values like any other, but a row without an id is neither edited nor
an earlier holder of a line; repeated rows are judged alike, and one of them stays behind near-duplicate removal (which goes by id, so rows
that share id and text stay together); ties go to the smallest id. Further columns, whatever their names, are passed on to the mix. Empty tables
stay empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftglass.llm import lines, minhash, mixing, packing, toxicity
from driftglass.llm.common import prepare, stage


#: Share of its words that a document must keep when lines are deleted; one that keeps less was a copy but for scraps, and goes.
LEAST_SHARE = 0.2


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the table of labels."""
    prepare(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one holds; those that nothing, or next to nothing, is left of go."""
    prepare(spark)
    return lines.drop_repeated(docs, least_share=LEAST_SHARE)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each component of near duplicates: five-word shingles, similarity of 0.8 or more."""
    prepare(spark)
    return minhash.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    prepare(spark)
    return mixing.repeat_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    prepare(spark)
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_stage), ("minhash_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL cannot express the classifier, the alignment or the tokenizer; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, function) in enumerate(STAGES):
        result = function(spark, docs, sf_dir)
        docs = result if number == len(STAGES) - 1 else stage(result, f"pipeline-{name}")
    return docs
