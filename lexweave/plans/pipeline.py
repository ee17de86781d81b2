"""The phases as functions over stored tables; a phase whose table is there is not run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, compare, curate, dynamics, index, score


class Workspace:
    """Lexicons (corpus, idx, head, definition) and all tables made from them, as Parquet under one folder."""

    TABLES = ("lexicon", "single_god", "pairs", "pair_index", "agreement", "semantic_difference", "common", "eod", "diffs", "steps")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def has(self, name: str) -> bool:
        """Whether the table was committed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(name)}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name))

    def keep(self, name: str, make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        if not self.has(name):
            out = make().write.mode("overwrite")
            (out.partitionBy(by) if by else out).parquet(self._path(name))
        return self.table(name)

    def curate(self, raw: DataFrame) -> DataFrame:
        self.keep("lexicon", lambda: curate.reindexed(curate.self_contained(raw)))
        self.keep("common", lambda: score.common_vocabulary(self.table("lexicon"), raw.select("corpus").distinct().count()))
        return self.table("lexicon")

    def run_od(self) -> DataFrame:
        self.keep("single_god", lambda: score.single_god(self.table("lexicon")))
        return self.keep("pairs", lambda: score.sod_pairs(self.table("lexicon")), "corpus")

    def run_analysis(self) -> tuple[DataFrame, DataFrame]:
        pairs = self.keep("pair_index", lambda: index.pair_index(self.run_od()).repartitionByRange("corpus", "w").sortWithinPartitions("corpus", "w"), "corpus")
        return self.keep("agreement", lambda: analysis.agreement(pairs)), self.keep("semantic_difference", lambda: analysis.semantic_difference(pairs))

    def run_eod(self, corpora: DataFrame) -> tuple[DataFrame, DataFrame]:
        self.run_analysis()
        eod = self.keep("eod", lambda: score.eod(self.table("lexicon"), corpora, self.table("common")))
        return eod, self.keep("diffs", lambda: compare.pairwise_diff(self.table("pair_index"), self.table("lexicon"), self.table("common"), corpora), "combo")

    def run_dynamics(self, trajectories: int = 100, max_steps: int = 100) -> tuple[DataFrame, DataFrame]:
        self.run_analysis()
        pairs = self.table("pair_index")
        bins = index.spectrum(pairs)
        ranked = pairs.join(index.percentile_rank(pairs).select("corpus", "w", "partner", "pctl"), ["corpus", "w", "partner"], "left")
        steps = self.keep("steps", lambda: dynamics.walk(dynamics.start_pairs(index.mutual_pairs(bins), trajectories), bins, ranked, max_steps))
        return dynamics.dynamics_stats(steps), dynamics.dynamics_hist(steps)

    def status(self) -> dict[str, int | None]:
        """Rows of each table, None where it is not made yet."""
        return {name: self.table(name).count() if self.has(name) else None for name in self.TABLES}

    def validate(self, a: str, b: str) -> DataFrame:
        """The level trace of a pair of words; raises if the pair does not end with a score in some corpus."""
        lexicon = self.table("lexicon")
        pairs = score.word_pairs(lexicon).where(F.col("a").isin(a, b) & F.col("b").isin(a, b))
        if score.sod_pairs(lexicon, pairs).where("sod = -1 OR tl <= 0").count():
            raise ValueError(f"{a} and {b} do not terminate")
        return score.sod_trace(lexicon, F.col("a").isin(a, b), F.col("b").isin(a, b))

    def check_eod(self, word: str) -> DataFrame:
        """The word's score and level in every combination; raises if some combination has none although both corpora define it."""
        rows = self.table("eod").where(F.col("word") == word)
        if rows.where("eod_score = -1 OR eod_tl <= 0").where("eod_score <> -2").count():
            raise ValueError(f"{word} does not terminate")
        return rows

    def partners(self, corpus: str, w: int) -> DataFrame:
        """The index rows of one word. Files are by corpus and sorted by word, so others are skipped by their bounds."""
        return self.table("pair_index").where((F.col("corpus") == corpus) & (F.col("w") == w))
