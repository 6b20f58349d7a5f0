"""The corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, packing.

Each stage works on all that the stage before it kept. A stage takes (spark, docs, sf_dir), reads
the labels or the benchmark from ``sf_dir``, and returns the documents it keeps with the columns
it got; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkproof.llm import decontaminate, packing, quality, queries, simhash, substring
from inkproof.llm.common import discard, materialise, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.deduplicate(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut from the text; a document that has nothing else goes."""
    return substring.deduplicate(docs, count_col=None, keep_emptied=False)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents and their places in the training sequences."""
    return packing.pack(packing.pieces(docs, queries.tokenizer())).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: Learned scores, rolling hashes and tokenizer ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, old = materialise(stage(spark, docs, sf_dir)), before
        if old is not None:  # nothing reads the stage before the last one again
            discard(old)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
