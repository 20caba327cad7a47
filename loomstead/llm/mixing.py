"""Poisson replication of documents to target source weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import kept, shuffle_width

#: Sources whose rates may be broadcast, at about 400 bytes each; more of them are joined by a shuffle of ids.
MOST_BROADCAST = 20_000
#: Names that the operator adds; an input column of such a name comes back with "_in" appended.
ADDED = ("n_copies", "copy", "mix_key")


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from an MD5 digest of the parts, the same in any SQL engine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, ratio: float, source_col: str, text_col: str) -> DataFrame:
    """(source, rate, cdf): mean repetitions that bring each source to its share, and the Poisson distribution function.

    Size is UTF-8 bytes plus one a document.  Without given weights a source weighs size ** temperature.
    Sources that given weights leave out weigh 0 and drop out.  The output aims at ``ratio`` times the input size.
    """
    size = F.length(F.coalesce(F.col(text_col), F.lit("")).cast("binary")) + 1
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).cast("double").alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("size", F.lit(temperature)))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map(F.lit(""), F.lit(0.0))
        weighed = sizes.withColumn("weight", F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0.0)))
    whole = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("size").alias("all_size"))
    rates = weighed.join(F.broadcast(whole)).withColumn("rate", F.col("weight") / F.nullif("all_weight", F.lit(0.0)) * F.col("all_size") * F.lit(ratio) / F.col("size"))
    most = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    step = lambda acc, k: F.struct(
        (acc["log"] + F.log(F.col("rate")) - F.log(k.cast("double"))).alias("log"),
        (acc["sum"] + F.exp(acc["log"] + F.log(F.col("rate")) - F.log(k.cast("double")))).alias("sum"),
        F.concat(acc["cdf"], F.array(acc["sum"])).alias("cdf"),
    )
    start = F.struct((-F.col("rate")).alias("log"), F.exp(-F.col("rate")).alias("sum"), F.array().cast("array<double>").alias("cdf"))
    cdf = F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: F.concat(acc["cdf"], F.array(acc["sum"])))
    return rates.where("rate > 0").select("source", "rate", cdf.alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, ratio: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The input's columns with n_copies, copy (from 1) and mix_key, one row a copy, in the order of mix_key.

    A document's count inverts the Poisson distribution of its source's rate at a hash of seed and id,
    so it does not depend on partitions or retries.  Null sources are a source of their own; a null id
    hashes as such; repeated rows are replicated each; null texts weigh one byte; an empty table stays empty.

    Rates are one small row a source, written and counted first: few are broadcast, so texts are not
    shuffled by source, and a hot source is no task.  Texts are shuffled once, to the range of their key:
    keys are uniform, so ranges are equal without a sample.
    """
    mark = "loomstead mix "
    clash = [c for c in docs.columns if c.lower() in ADDED]
    for c in clash:
        docs = docs.withColumnRenamed(c, f"{c}_in")
    rates = source_rates(docs, weights, temperature, ratio, source_col, text_col).select(F.col("source").alias(mark + "source"), F.col("cdf").alias(mark + "cdf"))
    rates = kept(rates, "mix-rates")
    rates = F.broadcast(rates) if rates.count() <= MOST_BROADCAST else rates.hint("merge")
    joined = docs.join(rates, docs[source_col].eqNullSafe(F.col(f"`{mark}source`")))
    u = unit_hash(F.lit(seed), F.col(id_col))
    counted = joined.withColumn("n_copies", F.size(F.filter(F.col(f"`{mark}cdf`"), lambda c: c <= u)))
    copies = counted.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("copy").cast("string")).cast("binary"))
    copies = copies.withColumn("mix_key", key).drop(mark + "source", mark + "cdf")
    width = shuffle_width(docs.sparkSession)
    share = F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") * width
    return copies.repartitionById(width, F.shiftright(share, 32).cast("int")).sortWithinPartitions("mix_key")
