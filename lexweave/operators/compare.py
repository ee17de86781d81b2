"""Differences of pair scores between corpora and their summaries; quantiles are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .score import combos


def pairwise_diff(index: DataFrame, lexicon: DataFrame, common: DataFrame, corpora: DataFrame) -> DataFrame:
    """(combo, master_idx1, master_idx2, diff_sod, diff_sod_tl): first corpus less second, for pairs scored in both."""
    names = lexicon.join(common, lexicon["head"] == common["word"]).select("corpus", "idx", "master_idx")
    side = lambda c, n: names.select("corpus", F.col("idx").alias(c), F.col("master_idx").alias(n))
    rows = index.join(side("w", "m1"), ["corpus", "w"]).join(side("partner", "m2"), ["corpus", "partner"]).where("m1 < m2").select("corpus", F.col("m1").alias("master_idx1"), F.col("m2").alias("master_idx2"), "sod", "tl")
    keys = ["master_idx1", "master_idx2"]
    a = rows.select(F.col("corpus").alias("a"), *keys, F.col("sod").alias("sod_a"), F.col("tl").alias("tl_a"))
    b = rows.select(F.col("corpus").alias("b"), *keys, F.col("sod").alias("sod_b"), F.col("tl").alias("tl_b"))
    return a.join(combos(corpora), "a").join(b, ["b", *keys]).select("combo", *keys, (F.col("sod_a") - F.col("sod_b")).alias("diff_sod"), (F.col("tl_a") - F.col("tl_b")).alias("diff_sod_tl"))


def eod_summary(table: DataFrame) -> DataFrame:
    return table.where("eod_score > -1").groupBy("combo").agg(F.count("*").alias("n"), F.round(F.avg("eod_score"), 6).alias("mean_score"), F.round(F.median("eod_score"), 6).alias("median_score"), F.round(F.avg("eod_tl"), 6).alias("mean_tl"), F.round(F.median("eod_tl"), 6).alias("median_tl"))


def global_stats(common: DataFrame) -> DataFrame:
    return common.agg(F.count("*").alias("n_words")).select("n_words", F.expr("n_words * (n_words - 1) div 2").alias("n_pairs"))


def long_form(diffs: DataFrame) -> DataFrame:
    """(combo, metric, x)."""
    return diffs.select("combo", F.explode(F.map_from_arrays(F.array(F.lit("diff_sod"), F.lit("diff_sod_tl")), F.array(F.col("diff_sod"), F.col("diff_sod_tl").cast("long")))).alias("metric", "x"))


def diff_net_mean(diffs: DataFrame, common: DataFrame) -> DataFrame:
    """Rows, net means, and the share of all pairs that was compared."""
    per = diffs.groupBy("combo").agg(F.count("*").alias("n"), F.round(F.avg("diff_sod"), 6).alias("net_mean_sod"), F.round(F.avg("diff_sod_tl"), 6).alias("net_mean_tl"))
    return per.crossJoin(global_stats(common).select("n_pairs")).select("combo", "n", "net_mean_sod", "net_mean_tl", F.round(100.0 * F.col("n") / F.col("n_pairs"), 6).alias("coverage_pct"))  # one row


def diff_stats(diffs: DataFrame) -> DataFrame:
    return long_form(diffs).groupBy("combo", "metric").agg(F.round(F.median("x"), 6).alias("net_median"), F.round(F.avg(F.abs("x")), 6).alias("abs_mean"), F.round(F.median(F.abs("x")), 6).alias("abs_median"))


def diff_outliers(diffs: DataFrame) -> DataFrame:
    """Quartiles of log10(|x| + 1), and how many values lie strictly beyond 1.5 interquartile ranges."""
    logs = long_form(diffs).withColumn("v", F.log10(F.abs("x") + 1))
    q = logs.groupBy("combo", "metric").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).select("combo", "metric", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    far = (F.col("v") < F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) | (F.col("v") > F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    per = logs.join(q, ["combo", "metric"]).groupBy("combo", "metric", "q1", "q3").agg(F.count("*").alias("n"), F.sum(far.cast("long")).alias("outliers"))
    return per.select("combo", "metric", F.round("q1", 6).alias("q1"), F.round("q3", 6).alias("q3"), "n", "outliers", F.round(100.0 * F.col("outliers") / F.col("n"), 6).alias("outlier_pct"))


def log_histogram_sparse(diffs: DataFrame) -> DataFrame:
    """Counts by floor(log10(|x| + 1)), bins without rows left out."""
    return long_form(diffs).groupBy("combo", "metric", F.floor(F.log10(F.abs("x") + 1)).alias("log10_bin")).agg(F.count("*").alias("n"))


def log_histogram(diffs: DataFrame) -> DataFrame:
    """Counts by integer bins 0 .. ceil(max) + 1, with bins without rows; the last bin is closed."""
    logs = long_form(diffs).withColumn("v", F.log10(F.abs("x") + 1))
    top = logs.groupBy("combo", "metric").agg(F.ceil(F.max("v")).alias("top"))
    bins = top.select("combo", "metric", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("bin"))
    counts = logs.join(top, ["combo", "metric"]).groupBy("combo", "metric", F.least(F.floor("v"), F.col("top")).alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counts, ["combo", "metric", "bin"], "left").select("combo", "metric", "bin", F.coalesce("n", F.lit(0)).alias("n"))
