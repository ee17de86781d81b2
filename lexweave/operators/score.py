"""Pair scores by recursive expansion with cancellation.

With W_m(s, w) the walks of length m from seed s to w and d(o, w) the other seed's distance (far if unreachable):
the termination level is the least over sides and m of max(m, 1, max of d over the support of level m); the score sums m * W_m over
words with d beyond it, up to that level; beyond the convergence depth plus one the pair is not terminated (-1).
Scores are taken tile by tile (tiles.py); the trace of a pair joins walks and distances of its two words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import depth, distances, edges_of, walks
from .tiles import pair_scores, same_word_scores
from ..tables import written


def vocabulary(lexicon: DataFrame) -> DataFrame:
    return lexicon.select("corpus", "idx", "head")


def seeds_of(lexicon: DataFrame) -> DataFrame:
    return lexicon.select("corpus", F.col("head").alias("seed")).distinct()


def word_pairs(lexicon: DataFrame) -> DataFrame:
    """(corpus, idx1, idx2, a, b): all unordered pairs, idx1 < idx2."""
    a, b = (vocabulary(lexicon).select("corpus", F.col("idx").alias(i), F.col("head").alias(h)) for i, h in (("idx1", "a"), ("idx2", "b")))
    return a.join(b, "corpus").where("idx1 < idx2").select("corpus", "idx1", "idx2", "a", "b")


def single_god(lexicon: DataFrame) -> DataFrame:
    """Convergence depth of each word."""
    god = depth(distances(seeds_of(lexicon), edges_of(lexicon)), ["corpus", "seed"])
    return god.join(vocabulary(lexicon), (god["corpus"] == lexicon["corpus"]) & (god["seed"] == lexicon["head"])).select(god["corpus"], "idx", "god")


def sod_pairs(lexicon: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(corpus, idx1, idx2, sod, tl, god) of all pairs, or of the given few."""
    few = None if pairs is None else pairs.select("corpus", F.col("idx1").cast("int").alias("idx1"), F.col("idx2").cast("int").alias("idx2"))
    return pair_scores(written(lexicon.select("corpus", F.col("idx").cast("int").alias("idx"), "head", "definition"), "lexicon"), few)


def sod_trace(lexicon: DataFrame, a: Column, b: Column) -> DataFrame:
    """The levels of the pairs (idx1, idx2, a, b) for which both conditions hold: (corpus, a, b, side, lvl, w, cnt, cancelled_at); cancelled_at is null if never."""
    pairs = word_pairs(lexicon).where(a & b)
    edges, seeds = edges_of(lexicon), seeds_of(lexicon)
    dist = written(distances(seeds, edges), "dist")
    levels = (dist.agg(F.max("d")).first()[0] or 0) + 2
    counts = walks(seeds, edges, levels)
    sides = pairs.select("corpus", "a", "b", F.lit(1).alias("side"), F.col("a").alias("seed"), F.col("b").alias("other")).unionByName(pairs.select("corpus", "a", "b", F.lit(2).alias("side"), F.col("b").alias("seed"), F.col("a").alias("other")))
    far = dist.select("corpus", F.col("seed").alias("other"), "w", F.col("d").alias("cancelled_at"))
    return sides.join(counts, ["corpus", "seed"]).join(far, ["corpus", "other", "w"], "left").select("corpus", "a", "b", "side", "lvl", "w", F.col("cnt").cast("long").alias("cnt"), "cancelled_at")


def common_vocabulary(lexicon: DataFrame, corpora: int) -> DataFrame:
    """(master_idx, word): words that head a definition in every one of so many corpora, sorted, from 0; none if a corpus has no rows."""
    words = lexicon.groupBy("head").agg(F.countDistinct("corpus").alias("n")).where(F.col("n") == corpora).select(F.col("head").alias("word"))
    return words.select((F.row_number().over(Window.orderBy("word")) - 1).cast("int").alias("master_idx"), "word")


def combos(corpora: DataFrame) -> DataFrame:
    """(combo, a, b): pairs of corpora (corpus, ord) in their order."""
    a, b = (corpora.select(F.col("corpus").alias(c), F.col("ord").alias(f"ord_{c}")) for c in "ab")
    return a.crossJoin(b).where("ord_a < ord_b").select(F.concat_ws("_vs_", "a", "b").alias("combo"), "a", "b")  # a few names


def eod_god(lexicon: DataFrame, corpora: DataFrame, words: DataFrame) -> DataFrame:
    """(combo, word, god): convergence depth on the union of two corpora's graphs."""
    pairs, edges = combos(corpora), edges_of(lexicon)
    both = edges.join(pairs, (edges["corpus"] == pairs["a"]) | (edges["corpus"] == pairs["b"])).groupBy("combo", "head", "tok").agg(F.sum("mult").alias("mult")).withColumnRenamed("combo", "corpus")
    seeds = words.crossJoin(pairs.select("combo")).select(F.col("combo").alias("corpus"), F.col("word").alias("seed"))  # each word in each of a few combinations
    god = depth(distances(seeds, both), ["corpus", "seed"])
    return god.select(F.col("corpus").alias("combo"), F.col("seed").alias("word"), "god")


def eod(lexicon: DataFrame, corpora: DataFrame, words: DataFrame) -> DataFrame:
    """(master_idx, word, combo, eod_score, eod_tl): the same word in two corpora. Counts do not multiply and level 0 does not end
    the expansion; a word that heads no definition in one of the corpora scores -2."""
    lexicon = written(lexicon.select("corpus", F.col("idx").cast("int").alias("idx"), "head", "definition"), "lexicon")
    pairs = combos(corpora)
    scored = same_word_scores(lexicon, pairs, words)
    every = words.crossJoin(pairs)  # each word in each of a few combinations
    missing = F.lit(-2)
    return every.join(scored, ["combo", "word"], "left").select("master_idx", "word", "combo", F.coalesce("sod", missing).alias("eod_score"), F.coalesce("tl", missing).alias("eod_tl"))


def eod_wide(table: DataFrame, names: list[str]) -> DataFrame:
    """One row for each word, a score and a level column for each combination."""
    return table.groupBy("master_idx", "word").pivot("combo", names).agg(F.first("eod_score").alias("score"), F.first("eod_tl").alias("tl"))


def one_vs_all(pairs: DataFrame, lexicon: DataFrame, word: Column) -> DataFrame:
    """Pairs that hold the words for which the condition on head is true."""
    chosen = lexicon.where(word).select("corpus", F.col("idx").alias("i"))
    return pairs.join(chosen, "corpus").where((F.col("idx1") == F.col("i")) | (F.col("idx2") == F.col("i"))).drop("i").distinct()
