"""Symmetric pair index, spectra of 100 equal bins, percentile ranks, and start pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 100


def pair_index(pairs: DataFrame) -> DataFrame:
    """(corpus, w, partner, sod, tl): both directions of each terminated pair."""
    good = pairs.where("sod <> -1")
    return good.select("corpus", F.col("idx1").alias("w"), F.col("idx2").alias("partner"), "sod", "tl").unionByName(good.select("corpus", F.col("idx2").alias("w"), F.col("idx1").alias("partner"), "sod", "tl"))


def spectrum(index: DataFrame) -> DataFrame:
    """index with score over 0 and its bin among the word's partners, ties by partner."""
    order = Window.partitionBy("corpus", "w").orderBy("sod", "partner")
    return index.where("sod > 0").withColumn("bin", F.ntile(BINS).over(order)).select("corpus", "w", "partner", "sod", "bin")


def percentile_rank(index: DataFrame) -> DataFrame:
    """Rank 1..100 of each partner's score: ceil(100 * share of scores not above it)."""
    up_to = Window.partitionBy("corpus", "w").orderBy("sod").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.ceil(F.lit(100.0) * F.count("*").over(up_to) / F.count("*").over(Window.partitionBy("corpus", "w")))
    return index.where("sod > 0").select("corpus", "w", "partner", "sod", F.least(F.lit(100), F.greatest(F.lit(1), rank)).cast("int").alias("pctl"))


def mutual_pairs(bins: DataFrame) -> DataFrame:
    """(corpus, bin, a, b): pairs in the same bin of each other's spectrum, a < b."""
    a, b = bins.select("corpus", "bin", F.col("w").alias("a"), F.col("partner").alias("b")), bins.select("corpus", "bin", F.col("partner").alias("a"), F.col("w").alias("b"))
    return a.where("a < b").join(b, ["corpus", "bin", "a", "b"])


def bin_diagnostics(bins: DataFrame) -> DataFrame:
    """Sizes of bins over words: mean, median, min, max and population deviation."""
    sizes = bins.groupBy("corpus", "w", "bin").agg(F.count("*").alias("n"))
    return sizes.groupBy("corpus", "bin").agg(F.round(F.avg("n"), 6).alias("mean_size"), F.round(F.median("n"), 6).alias("median_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.round(F.stddev_pop("n"), 6).alias("std_size"))


def start_pair_diagnostics(mutual: DataFrame, index: DataFrame, first: int = 500) -> DataFrame:
    """Scores of the first start pairs of each bin: how many, mean and median."""
    rank = F.row_number().over(Window.partitionBy("corpus", "bin").orderBy("a", "b"))
    some = mutual.withColumn("rank", rank).where(F.col("rank") <= first)
    scores = index.select("corpus", F.col("w").alias("a"), F.col("partner").alias("b"), "sod", "tl")
    return some.join(scores, ["corpus", "a", "b"]).groupBy("corpus", "bin").agg(F.count("*").alias("n"), F.round(F.avg("sod"), 6).alias("mean_sod"), F.round(F.median("sod"), 6).alias("median_sod"), F.round(F.avg("tl"), 6).alias("mean_tl"))
