"""Lexicons made from the relational tables, for queries that can be checked against SQL.

A part's name is a word. Each line item links its part's word to the word of the part numbered like its supplier; a word's definition
holds the words it is linked to clearly more often than to others (2 deviations over the mean of its links, twice from 3 on), commonest first. The three
return flags give three base lexicons, three variants are derived from the first, and each is closed over its own vocabulary.
All rows of the tables count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import curate
from ..tables import written

CORPORA = ("ground_filtered", "null_model", "random_removal", "targeted_removal", "ai_generated", "merriam_webster")
BASES = {"A": "ground_filtered", "N": "ai_generated", "R": "merriam_webster"}
TOP = 3

_kept: dict[tuple, DataFrame] = {}


def corpora(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, k) for k, c in enumerate(CORPORA)], "corpus string, ord int")


def base_lexicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus, idx, head, definition) of the three base lexicons, not closed."""
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("")).alias("word"))
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_partkey", "l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"))
    counts = items.groupBy("l_returnflag", "l_partkey", "l_suppkey").agg(F.count("*").alias("c"), F.min("line").alias("line"))  # before the joins, so these see few rows
    links = counts.join(names.select(F.col("p_partkey").alias("l_partkey"), F.col("word").alias("head")), "l_partkey").join(names.select(F.col("p_partkey").alias("l_suppkey"), F.col("word").alias("tok")), "l_suppkey")
    cells = links.groupBy("l_returnflag", "head", "tok").agg(F.sum("c").alias("c"), F.min("line").alias("line"))
    by = Window.partitionBy("l_returnflag", "head")
    cells = cells.withColumn("k", F.count("*").over(by)).withColumn("s", F.sum("c").over(by)).withColumn("q", F.sum(F.col("c") * F.col("c")).over(by)).withColumn("line", F.min("line").over(by))
    over, spread = F.col("k") * F.col("c") - F.col("s"), F.col("k") * F.col("q") - F.col("s") * F.col("s")
    clear = cells.where((over > 0) & (over * over > 4 * spread)).withColumn("mult", F.when(over * over > 9 * spread, 2).otherwise(1))
    items_ = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "tok", "mult")))
    words = F.flatten(F.transform(items_, lambda x: F.array_repeat(x["tok"], x["mult"])))
    defined = clear.groupBy("l_returnflag", "head", "line").agg(words.alias("definition"))
    corpus = F.when(F.col("l_returnflag") == "A", BASES["A"]).when(F.col("l_returnflag") == "N", BASES["N"]).otherwise(BASES["R"])
    return defined.select(corpus.alias("corpus"), F.row_number().over(Window.partitionBy("l_returnflag").orderBy("line", "head")).alias("idx"), "head", "definition")


def raw_lexicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base lexicons and the three variants of the first, not closed."""
    base = written(base_lexicons(spark, sf_dir), "base")
    ground = base.where(F.col("corpus") == "ground_filtered")
    variants = {"null_model": curate.null_model(ground), "random_removal": curate.random_removal(ground), "targeted_removal": curate.targeted_removal(ground, TOP)}
    out = base
    for name, lexicon in variants.items():
        out = out.unionByName(lexicon.withColumn("corpus", F.lit(name)).select(base.columns))
    return out


def _once(name: str, spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """A table that several queries of a session share."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = written(make(), name)
    return _kept[key]


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once("raw", spark, sf_dir, lambda: raw_lexicons(spark, sf_dir))


def lexicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six, closed, with idx counted anew."""
    return _once("lexicons", spark, sf_dir, lambda: curate.reindexed(curate.self_contained(raw(spark, sf_dir))))


ROUNDS = 12


def raw_sql() -> str:
    """CTEs t(corpus, idx, head, pos, tok) of raw lexicons."""
    rnd = lambda tag, rest="|| '|' || head": f"CAST(('0x' || substr(md5('42|{tag}' {rest}), 1, 8)) AS BIGINT)"
    return f"""
pn AS MATERIALIZED (SELECT p_partkey, replace(p_name, ' ', '') AS word FROM part),
cells AS MATERIALIZED (SELECT l_returnflag AS f, h.word AS head, t.word AS tok, count(*) AS c, min(l_orderkey * 8 + l_linenumber) AS line
  FROM lineitem JOIN pn h ON h.p_partkey = l_partkey JOIN pn t ON t.p_partkey = l_suppkey GROUP BY ALL),
sums AS (SELECT f, head, count(*) AS k, sum(c) AS s, sum(c * c) AS q, min(line) AS line FROM cells GROUP BY ALL),
clear AS (SELECT f, head, tok, c, sums.line, CASE WHEN (k * c - s) * (k * c - s) > 9 * (k * q - s * s) THEN 2 ELSE 1 END AS mult
  FROM cells JOIN sums USING (f, head) WHERE k * c > s AND (k * c - s) * (k * c - s) > 4 * (k * q - s * s)),
base AS MATERIALIZED (SELECT CASE f WHEN 'A' THEN 'ground_filtered' WHEN 'N' THEN 'ai_generated' ELSE 'merriam_webster' END AS corpus,
  dense_rank() OVER (PARTITION BY f ORDER BY line, head) AS idx, head, row_number() OVER (PARTITION BY f, head ORDER BY c DESC, tok, rep) - 1 AS pos, tok
  FROM (SELECT *, unnest(range(mult)) AS rep FROM clear)),
g AS (SELECT * FROM base WHERE corpus = 'ground_filtered'),
gv AS (SELECT head, row_number() OVER (ORDER BY idx) - 1 AS k FROM (SELECT DISTINCT head, idx FROM g)),
nm AS (SELECT 'null_model' AS corpus, g.idx, g.head, pos, v.head AS tok FROM g JOIN gv v ON v.k = {rnd("null", "|| '|' || g.head || '|' || pos")} % (SELECT count(*) FROM gv)),
gs AS (SELECT head, count(*) AS n FROM g GROUP BY head),
rr AS (SELECT 'random_removal' AS corpus, idx, head, pos, tok FROM g JOIN gs USING (head)
  WHERE NOT (n > 1 AND {rnd("hit")} * 100 < 20 * 4294967296 AND pos = {rnd("at")} % n)),
gf AS (SELECT tok, row_number() OVER (ORDER BY n DESC, i, p) AS rank FROM (SELECT tok, count(*) AS n, min(idx * 1000 + pos) AS i, 0 AS p FROM g GROUP BY tok) WHERE tok IN (SELECT head FROM g)),
tr AS (SELECT 'targeted_removal' AS corpus, idx, head, pos, tok FROM g
  WHERE tok NOT IN (SELECT tok FROM gf WHERE rank <= {TOP}) AND head NOT IN (SELECT tok FROM gf WHERE rank <= {TOP})),
t0 AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT * FROM nm UNION ALL SELECT * FROM rr UNION ALL SELECT * FROM tr)"""


def closed_sql(rounds: int = ROUNDS) -> str:
    """CTEs up to lex(corpus, idx, head, pos, tok) of closed lexicons; unrolled more rounds than the tables need."""
    steps = ",\n".join(f"t{k} AS MATERIALIZED (SELECT * FROM t{k - 1} x WHERE EXISTS (SELECT 1 FROM t{k - 1} y WHERE y.corpus = x.corpus AND y.head = x.tok))" for k in range(1, rounds + 1))
    return f"""{raw_sql()},
{steps},
lex AS MATERIALIZED (SELECT corpus, dense_rank() OVER (PARTITION BY corpus ORDER BY idx) AS idx, head, row_number() OVER (PARTITION BY corpus, head ORDER BY pos) - 1 AS pos, tok FROM t{rounds}),
vocab AS MATERIALIZED (SELECT DISTINCT corpus, idx, head FROM lex),
ed AS MATERIALIZED (SELECT corpus, head, tok, count(*) AS mult FROM lex GROUP BY ALL)"""
