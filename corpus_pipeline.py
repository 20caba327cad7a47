"""A cleaning pipeline over documents: language, near duplicates, repeated passages, source mix, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomstead.llm import stages
from loomstead.llm.common import DOCUMENT_COLUMNS, documents, kept

STAGES = [
    ("language_id", stages.identified),
    ("minhash_near_dedup", stages.without_near_duplicates),
    ("suffix_array_dedup", stages.without_repeats),
    ("source_mix", stages.mixed),
    ("sentencepiece", stages.encoded),
]

#: Models and sampled lattices have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of a data folder."""
    docs = documents(spark, sf_dir).select(*DOCUMENT_COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept(docs, name)
    return docs
