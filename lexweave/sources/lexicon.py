"""Lexicons as text (`word: token token ...`) and as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIRS = T.StructType([T.StructField(n, t) for n, t in (("idx1", T.IntegerType()), ("idx2", T.IntegerType()), ("sod", T.LongType()), ("tl", T.IntegerType()), ("god", T.IntegerType()))])


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parse_lexicon(lines: DataFrame) -> DataFrame:
    """(corpus, line_no, line) to (corpus, idx, head, definition): heads lowered, tokens as they are; of a repeated head the last
    definition and the first place count; lines that are blank or have no colon are skipped; idx is 1-based."""
    parts = F.split(_strip(F.col("line")), ":", 2)
    rows = lines.where(F.col("line").contains(":")).select("corpus", "line_no", F.lower(_strip(parts[0])).alias("head"), F.filter(F.split(_strip(parts[1]), r"(?U)\s+"), lambda t: t != "").alias("definition"))
    heads = rows.groupBy("corpus", "head").agg(F.min("line_no").alias("first"), F.max_by("definition", "line_no").alias("definition"))
    return heads.select("corpus", F.row_number().over(Window.partitionBy("corpus").orderBy("first")).alias("idx"), "head", "definition")


def read_lexicon(spark: SparkSession, path: str, corpus: str) -> DataFrame:
    """A lexicon of one text file or several. Lines are in order of file name, place of the split and place in it."""
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id")).alias("line_no")
    return parse_lexicon(spark.read.text(path).select(F.lit(corpus).alias("corpus"), order, F.col("value").alias("line")))


def lexicon_lines(lexicon: DataFrame) -> DataFrame:
    """(corpus, idx, line): the text form, without words whose definition is empty."""
    return lexicon.where(F.size("definition") > 0).select("corpus", "idx", F.concat_ws(": ", "head", F.concat_ws(" ", "definition")).alias("line"))


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """Text in index order; the files' names keep the order where the sort makes several."""
    lexicon_lines(lexicon).orderBy("corpus", "idx").select("line").write.mode("overwrite").text(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A pair table as blank-separated text; malformed rows are dropped."""
    return spark.read.csv(path, sep=" ", schema=PAIRS, mode="DROPMALFORMED")


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select(PAIRS.names).write.mode("overwrite").csv(path, sep=" ")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A word list: distinct words that are not blank."""
    return spark.read.text(path).select(_strip(F.col("value")).alias("word")).where("word <> ''").distinct()


def resume_todo(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work that is not done yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")
