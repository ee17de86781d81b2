"""Curation: closing a lexicon over its own vocabulary, and perturbed variants. Random choices are md5 digests, so they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written


def tokens(lexicon: DataFrame) -> DataFrame:
    """(corpus, idx, head, pos, tok): one row for each token."""
    return lexicon.select("corpus", "idx", "head", F.posexplode("definition").alias("pos", "tok"))


def gathered(rows: DataFrame) -> DataFrame:
    """Token rows back to definitions in order."""
    return rows.groupBy("corpus", "idx", "head").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]).alias("definition"))


def prune(lexicon: DataFrame, most: int | None = 100) -> tuple[DataFrame, DataFrame]:
    """The greatest self-contained part, as token rows, and the dropped token rows: tokens that head no definition go, then words without tokens,
    until nothing changes or after `most` rounds."""
    rows, dropped, rounds = written(tokens(lexicon), "tokens"), None, 0
    while most is None or rounds < most:
        heads = rows.select("corpus", F.col("head").alias("tok")).distinct()
        gone = written(rows.join(heads, ["corpus", "tok"], "left_anti"), "gone")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        rounds += 1
        if gone.isEmpty():
            break
        rows = written(rows.join(heads, ["corpus", "tok"], "left_semi").select(rows.columns), "tokens")
    return rows, dropped


def self_contained(lexicon: DataFrame, most: int | None = 100) -> DataFrame:
    return gathered(prune(lexicon, most)[0])


def reindexed(lexicon: DataFrame) -> DataFrame:
    """idx counted from 1 again in the same order."""
    return lexicon.withColumn("idx", F.row_number().over(Window.partitionBy("corpus").orderBy("idx")))


def dangling_counts(lexicon: DataFrame) -> DataFrame:
    """(corpus, tok, n): how often each token was dropped, over all rounds."""
    return prune(lexicon)[1].groupBy("corpus", "tok").agg(F.count("*").alias("n"))


def removed_headwords(lexicon: DataFrame) -> DataFrame:
    rows = prune(lexicon)[0]
    return lexicon.select("corpus", "head").distinct().join(rows.select("corpus", "head").distinct(), ["corpus", "head"], "left_anti")


def token_frequency(lexicon: DataFrame) -> DataFrame:
    """(corpus, tok, n, first): uses of each token, and the place of the first (idx, pos)."""
    return tokens(lexicon).groupBy("corpus", "tok").agg(F.count("*").alias("n"), F.min(F.struct("idx", "pos")).alias("first"))


def _ranked(lexicon: DataFrame) -> DataFrame:
    """Headwords by falling use as tokens, ties by first use."""
    heads = lexicon.select("corpus", F.col("head").alias("tok")).distinct()
    order = Window.partitionBy("corpus").orderBy(F.desc("n"), "first")
    return token_frequency(lexicon).join(heads, ["corpus", "tok"], "left_semi").withColumn("rank", F.row_number().over(order))


def top_tokens(lexicon: DataFrame, top: int = 20) -> DataFrame:
    return _ranked(lexicon).where(F.col("rank") <= top).select("corpus", "rank", "tok", "n")


def without(lexicon: DataFrame, removed: DataFrame) -> DataFrame:
    """lexicon without the words of removed (corpus, tok), as heads and as tokens; words left without tokens go."""
    rows = tokens(lexicon).join(removed, ["corpus", "tok"], "left_anti")
    return gathered(rows.join(removed.withColumnRenamed("tok", "head"), ["corpus", "head"], "left_anti"))


def targeted_removal(lexicon: DataFrame, top: int = 20) -> DataFrame:
    return without(lexicon, top_tokens(lexicon, top).select("corpus", "tok"))


def targeted_pct_removal(lexicon: DataFrame, pct: float) -> DataFrame:
    """Removes the top share of headwords, one at least, and closes the rest."""
    n = lexicon.groupBy("corpus").agg(F.greatest(F.lit(1), F.floor(F.count("*") * pct / 100)).alias("most"))
    gone = _ranked(lexicon).join(n, "corpus").where("rank <= most").select("corpus", "tok")
    return self_contained(without(lexicon, gone), None)


def chance(*parts: Column | str) -> Column:
    """A number from 0 to 2 ** 32 - 1 from the md5 of its parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def random_removal(lexicon: DataFrame, pct: int = 20, seed: int = 42) -> DataFrame:
    """With a chance of pct, one token of a definition of two or more is dropped."""
    hit = (F.size("definition") > 1) & (chance(F.lit(str(seed)), F.lit("hit"), "head") * 100 < F.lit(pct) * F.lit(2**32))
    at = chance(F.lit(str(seed)), F.lit("at"), "head") % F.size("definition")
    return lexicon.withColumn("at", F.when(hit, at).otherwise(F.lit(-1))).withColumn("definition", F.filter("definition", lambda t, i: i != F.col("at"))).drop("at")


def random_head_removal(lexicon: DataFrame, pct: float, seed: int = 42) -> DataFrame:
    order = Window.partitionBy("corpus").orderBy(chance(F.lit(str(seed)), F.lit("head"), "head"), "head")
    n = lexicon.groupBy("corpus").agg(F.floor(F.count("*") * pct / 100).alias("most"))
    gone = lexicon.select("corpus", "head").withColumn("rank", F.row_number().over(order)).join(n, "corpus").where("rank <= most").select("corpus", F.col("head").alias("tok"))
    return self_contained(without(lexicon, gone), None)


def null_model(lexicon: DataFrame, seed: int = 42) -> DataFrame:
    """Every token becomes a uniform headword of its corpus; definitions keep their lengths."""
    vocab = lexicon.select("corpus", F.col("head").alias("new"), (F.row_number().over(Window.partitionBy("corpus").orderBy("idx")) - 1).cast("long").alias("k"))
    n = lexicon.groupBy("corpus").agg(F.count("*").alias("n"))
    rows = tokens(lexicon).join(n, "corpus").withColumn("k", chance(F.lit(str(seed)), F.lit("null"), "head", F.col("pos").cast("string")) % F.col("n"))
    return gathered(rows.join(vocab, ["corpus", "k"]).select("corpus", "idx", "head", "pos", F.col("new").alias("tok")))


def valid_vocabulary(lexicon: DataFrame) -> DataFrame:
    """Heads and tokens of two letters or more and nothing but letters."""
    words = lexicon.select("corpus", F.col("head").alias("word")).unionByName(lexicon.select("corpus", F.explode("definition").alias("word")))
    return words.where(F.col("word").rlike(r"^\p{L}{2,}\z")).distinct()


def corpus_stats(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("corpus").agg(F.count("*").alias("n_words"), F.sum(F.size("definition")).alias("n_tokens"), F.round(F.avg(F.size("definition")), 6).alias("avg_length"))
