"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.llm import language_id, media, near_duplicates, pieces, repeats, sharding, token_counts, token_store, topk
from loomstead.llm.common import documents, kept
from loomstead.llm.mixing import mix

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def bounded_batches(spark: SparkSession) -> None:
    """Python batches of at most 1,000 rows, so long documents do not pile up in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > 1000 or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, "1000")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token shards with a minimal perfect hash index: written, then every document read back through the index."""
    bounded_batches(spark)
    path = token_store.write_token_shards(documents(spark, sf_dir), tokenizer_file(WORD_BPE))
    return token_store.with_starts(kept(token_store.read_token_shards(spark, path), "token-rows"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text that lie in a 50-byte string which also starts in an earlier document, removed."""
    bounded_batches(spark)
    cut = repeats.remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after: all documents inserted, toxic ones deleted, good ones revised to count an end id, and batches sent again."""
    bounded_batches(spark)
    counts = kept(token_counts.count_tokens(documents(spark, sf_dir), tokenizer_file(WORD_BPE), "word-bpe-49k"), "token-counts")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    good = labels.where("quality = 1 and toxic = 0").select("doc_id").distinct().join(toxic, "doc_id", "left_anti")
    rollup = token_counts.TokenRollup(spark)
    out = counts.join(toxic, "doc_id", "left_semi")
    old = counts.join(good, "doc_id", "left_semi")
    new = old.withColumn("n_tokens", F.col("n_tokens") + 1).withColumn("tokenizer", F.lit("word-bpe-49k+end"))
    batches = {"0001-insert": token_counts.inserts(counts), "0002-delete": token_counts.deletes(out), "0003-revise": token_counts.revisions(old, new)}
    for name, deltas in [*batches.items(), ("0001-insert", batches["0001-insert"]), ("0002-delete", batches["0002-delete"])]:
        rollup.commit(name, deltas)
    return rollup.totals()


def op4_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards of near equal bytes; equal texts stay together."""
    placed = sharding.shard_documents(documents(spark, sf_dir), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated to bring sources to square-root weights, in a global random order."""
    return mix(documents(spark, sf_dir)).select("mix_key", "doc_id", "copy", "n_copies", "source", "lang", "n_chars", "text")


def op6_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes of every vector whose id is divisible by 100, against all vectors."""
    codes = topk.sign_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.hamming_top_k(codes, codes.where("id % 100 = 0"), 10)


def op7_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a TIFF, written, and read back page by page."""
    bounded_batches(spark)
    return media.digests(kept(media.store(documents(spark, sf_dir)), "media"))


def op8_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components at 0.85 over three-word shingles."""
    bounded_batches(spark)
    return near_duplicates.near_duplicates(documents(spark, sf_dir), size=3, percent=85)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learnt from the documents outside the held-out fold."""
    bounded_batches(spark)
    docs = documents(spark, sf_dir)
    model = language_id.train(docs)
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op10_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every text with its piece ids, and whether decoding gave the text back."""
    bounded_batches(spark)
    return pieces.encode(documents(spark, sf_dir), tokenizer_file(PIECES))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    ops = (op1_token_store, op2_suffix_dedup, op3_token_counts, op4_lpt_sharding, op5_poisson_mix, op6_hamming_top_k, op7_tiff_media, op8_minhash_groups, op9_language_id, op10_sampled_pieces)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


MIX_SQL = """
WITH RECURSIVE sized AS (
  SELECT source, sum(strlen(coalesce(text, '')) + 1)::DOUBLE AS size FROM documents GROUP BY source),
weighed AS (SELECT source, size, pow(size, 0.5) AS weight FROM sized),
rates AS (
  SELECT source, weight / (SELECT sum(weight) FROM weighed) * (SELECT sum(size) FROM weighed) / size AS rate FROM weighed),
cdf(source, rate, k, lp, total) AS (
  SELECT source, rate, 0, -rate, exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, lp + ln(rate) - ln(k + 1), total + exp(lp + ln(rate) - ln(k + 1))
  FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
drawn AS (
  SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text,
         ('0x' || substr(md5('17|' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d),
counted AS (
  SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text, count(*) AS n_copies
  FROM drawn d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.total <= d.u
  GROUP BY ALL)
SELECT md5('17|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy) AS mix_key, doc_id, copy::INT AS copy,
       n_copies::INT AS n_copies, source, lang, n_chars, text
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM counted)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_poisson_mix": MIX_SQL, "op6_hamming_top_k": TOP_K_SQL}


TOP_K_SQL = """
WITH bits AS (
  SELECT vec_id AS id, list_reduce(list_prepend(0::UBIGINT, list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN (1::UBIGINT << (i - 1)::UBIGINT) ELSE 0::UBIGINT END)), lambda a, b: a | b) AS code
  FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (
  SELECT q.id AS query_id, b.id, bit_count(xor(q.code, b.code))::INT AS distance
  FROM bits q JOIN bits b ON q.id <> b.id WHERE q.id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs)
SELECT query_id, rank::INT AS rank, id, distance FROM ranked WHERE rank <= 10
"""
