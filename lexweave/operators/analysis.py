"""Level coincidence and semantic difference of word pairs over their common partners, by tiles of words (partners.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .partners import by_tiles, confusion, differences, matches


def _mutual(index: DataFrame) -> DataFrame:
    return index.select("corpus", F.col("w").alias("idx_a"), F.col("partner").alias("idx_b"), F.col("tl").alias("mutual_tl"))


def level_confusion(index: DataFrame) -> DataFrame:
    """How often partners at level_a of the earlier word are at level_b of the later one."""
    fields = [T.StructField("level_a", T.IntegerType()), T.StructField("level_b", T.IntegerType()), T.StructField("n", T.LongType())]
    return by_tiles(index, confusion, fields)


def square_confusion(confusion: DataFrame) -> DataFrame:
    """confusion with every combination of the pair's levels, 0 where there is none: its levels are few, so its matrix is, too."""
    keys = ["corpus", "idx_a", "idx_b"]
    levels = confusion.groupBy(*keys).agg(F.array_union(F.collect_set("level_a"), F.collect_set("level_b")).alias("levels"))
    cells = levels.select(*keys, "levels", F.explode("levels").alias("level_a")).select(*keys, "level_a", F.explode("levels").alias("level_b"))
    return cells.join(confusion, [*keys, "level_a", "level_b"], "left").select(*keys, "level_a", "level_b", F.coalesce("n", F.lit(0)).alias("n"))


def agreement(index: DataFrame) -> DataFrame:
    """By pair and level of the earlier word: common partners, those at the same level of the later word, and their share; the pair's own level, -1 if none."""
    fields = [T.StructField("level_a", T.IntegerType()), T.StructField("total", T.LongType()), T.StructField("matching", T.LongType())]
    per = by_tiles(index, matches, fields)
    return per.join(_mutual(index), ["corpus", "idx_a", "idx_b"], "left").select("corpus", "idx_a", "idx_b", F.coalesce("mutual_tl", F.lit(-1)).alias("mutual_tl"), "level_a", "total", "matching", F.round(100.0 * F.col("matching") / F.col("total"), 6).alias("pct"))


def agreement_summary(agreed: DataFrame) -> DataFrame:
    """By mutual level and level, over pairs with a mutual level of 0 or more."""
    rolled = agreed.where("mutual_tl >= 0").groupBy("corpus", "mutual_tl", "level_a").agg(F.sum("total").alias("total"), F.sum("matching").alias("matching"))
    return rolled.withColumn("avg_pct", F.round(100.0 * F.col("matching") / F.col("total"), 6))


def semantic_difference(index: DataFrame) -> DataFrame:
    """For each pair in the index: mean difference of log scores and of levels over common partners, 0 if there are none."""
    diff = by_tiles(index, differences, [T.StructField(c, T.DoubleType()) for c in "st"])
    pairs = _mutual(index).where("idx_a < idx_b").withColumnRenamed("mutual_tl", "mutual_sod_level")
    return pairs.join(diff, ["corpus", "idx_a", "idx_b"], "left").select("corpus", "idx_a", "idx_b", "mutual_sod_level", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("avg_sod_diff"), F.round(F.coalesce("t", F.lit(0.0)), 6).alias("avg_sod_term_diff"))


def semantic_difference_summary(differences: DataFrame) -> DataFrame:
    return differences.where("mutual_sod_level > 0").groupBy("corpus", "mutual_sod_level").agg(F.count("*").alias("n"), F.round(F.avg("avg_sod_diff"), 5).alias("mean_sod_diff"), F.round(F.avg("avg_sod_term_diff"), 5).alias("mean_term_diff"))
