"""The definition multigraph: edges, distances and walk counts. Keys are kept in a `corpus` column, so many graphs run at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written

COUNT = "decimal(38,0)"


def edges_of(lexicon: DataFrame) -> DataFrame:
    """(corpus, head, tok, mult) of (corpus, head, definition)."""
    return lexicon.select("corpus", "head", F.explode("definition").alias("tok")).groupBy("corpus", "head", "tok").agg(F.count("*").alias("mult"))


def distances(seeds: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """(corpus, seed, w, d): the least number of steps from each seed (corpus, seed) to each word it reaches, semi-naive, up to `most`."""
    links = written(edges.select("corpus", F.col("head").alias("w"), F.col("tok").alias("next")).distinct(), "links")
    front = written(seeds.select("corpus", "seed", F.col("seed").alias("w"), F.lit(0).alias("d")), "front")
    known = front
    for level in range(1, most + 1):
        step = front.join(links, ["corpus", "w"]).select("corpus", "seed", F.col("next").alias("w")).distinct()
        front = written(step.join(known.select("corpus", "seed", "w"), ["corpus", "seed", "w"], "left_anti").withColumn("d", F.lit(level)), "front")
        if front.isEmpty():
            break
        known = known.unionByName(front)
        if level % 8 == 0:
            known = written(known, "known")
    return known


def depth(dist: DataFrame, by: list[str], most: int = 100) -> DataFrame:
    """Convergence depth for each key: the first level that adds no word, at most `most`."""
    return dist.groupBy(*by).agg(F.least(F.max("d") + 1, F.lit(most)).cast("int").alias("god"))


def walks(seeds: DataFrame, edges: DataFrame, levels: int, multiply: bool = True) -> DataFrame:
    """(corpus, seed, lvl, w, cnt): walks of each length from each seed. Without multiply a word counts once however often it was
    reached, so cnt is the summed multiplicity of the edges into it from the level before."""
    links = written(edges.select("corpus", F.col("head").alias("w"), F.col("tok").alias("next"), "mult"), "links")
    level = written(seeds.select("corpus", "seed", F.lit(0).alias("lvl"), F.col("seed").alias("w"), F.lit(1).cast(COUNT).alias("cnt")), "walks")
    out = level
    for k in range(1, levels + 1):
        gain = F.col("cnt") * F.col("mult").cast("decimal(18,0)") if multiply else F.col("mult")
        step = level.join(links, ["corpus", "w"]).groupBy("corpus", "seed", F.col("next").alias("w")).agg(F.sum(gain.cast(COUNT)).cast(COUNT).alias("cnt"))
        level = written(step.select("corpus", "seed", F.lit(k).alias("lvl"), "w", "cnt"), "walks")
        out = out.unionByName(level)
    return out
