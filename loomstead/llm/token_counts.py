"""Token-count rollups kept up to date by signed deltas, with idempotent batch commits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.llm.common import by_size, fresh_path, tidy
from loomstead.llm.token_store import encoder

KEYS = ("source", "lang", "tokenizer")


def count_tokens(docs: DataFrame, tokenizer_path: str, version: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) of every whole text.

    A null or empty text has no tokens; null ids, sources and languages stay null; repeated rows are counted
    each; extra columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path)
        for b in batches:
            n: list[int] = []
            texts = b["t"].tolist()
            for rows_ in by_size([len(t) + 256 for t in texts], 1 << 20):
                n += [len(r) // enc.kind.itemsize for r in enc.encode(texts[rows_])]
            yield b[["doc_id", "source", "lang"]].assign(n_tokens=n)

    counted = rows.mapInPandas(tidy(run), "doc_id long, source string, lang string, n_tokens long")
    return counted.withColumn("tokenizer", F.lit(version))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Takes the old counts out and puts the new ones in; a changed source, language or tokenizer moves the row."""
    return deletes(old).unionByName(inserts(new))


class TokenRollup:
    """Additive totals by source, language and tokenizer version under one folder.

    A batch is pre-aggregated and written to its own folder, then counts as committed once Spark's
    commit marker is there.  A committed batch is not applied again, and a batch that broke off is
    written anew, so commits may be retried at will.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "rollup")

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def committed(self, batch: str) -> bool:
        fs, path = self._file(f"batch={batch}/_SUCCESS")
        return fs.exists(path)

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Apply a batch of signed deltas; False if it was committed before."""
        if self.committed(batch):
            return False
        deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def batches(self) -> list[str]:
        fs, path = self._file("")
        if not fs.exists(path):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(path))
        return [n[6:] for n in names if n.startswith("batch=") and self.committed(n[6:])]

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over the committed batches, without rows that came to nothing.

        Null sources and languages are keys of their own; no batches give no rows.
        """
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
        paths = [f"{self.path}/batch={b}" for b in self.batches()]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        summed = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self, batch: str) -> None:
        """Fold the committed batches into one new rollup folder's first batch and go on from there."""
        folded = TokenRollup(self.spark)
        folded.commit(batch, self.totals())
        self.path = folded.path
