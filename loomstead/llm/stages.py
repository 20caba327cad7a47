"""The pipeline's stages, each one operator applied to the documents that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstead.llm import language_id, near_duplicates, pieces, queries, repeats
from loomstead.llm.common import DOCUMENT_COLUMNS
from loomstead.llm.mixing import mix

#: A document goes if its language is undetermined or less likely than this.
LEAST_SCORE = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; null texts and texts without a letter go.  Nothing is learnt if no row has a language, and then all rows stay."""
    queries.bounded_batches(spark)
    model = language_id.train(docs)
    if not model.langs:
        return docs.select(*DOCUMENT_COLUMNS)
    return language_id.identify(docs, model).where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*DOCUMENT_COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): that of the least id.

    Texts without words and rows of a null id stay.  Repeated rows of one id stay or go together; an empty
    table stays empty.
    """
    queries.bounded_batches(spark)
    gone = near_duplicates.near_duplicates(docs, size=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*DOCUMENT_COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes or more that an earlier document has; documents with nothing left go.

    A character goes only if all of its bytes are covered.  Null and empty texts go; rows of a null id stay
    whole; rows of one id do not cut each other.
    """
    queries.bounded_batches(spark)
    return repeats.cleaned(docs).where(F.coalesce(F.col("text"), F.lit("")) != "").select(*DOCUMENT_COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to square-root source weights, in the order of the mix.

    Null sources are a source; rows of a null id, and repeated rows of one id, are drawn alike; an empty
    table stays empty.
    """
    return mix(docs).select(*DOCUMENT_COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sampled segmentation of each document, with its piece ids; the copies of a document are drawn apart.

    Copies are rows of equal id and text; they are numbered, as the tables between stages have no copy column.
    """
    queries.bounded_batches(spark)
    alike = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("source")
    numbered = docs.select("doc_id", "text", F.row_number().over(alike).alias("copy"))
    return pieces.encode(numbered, queries.tokenizer_file(queries.PIECES), copy_col="copy")
