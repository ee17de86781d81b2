"""Cumulative-snapshot collapse of logged conversations, and chat rendering.

A client that logs after every turn leaves snapshots, each a prefix of the next.  Each conversation's turns get rolling hashes: the hash
after turn k covers roles and texts of all turns up to k.  A conversation whose last hash and length is a prefix hash of a longer one
is a snapshot and goes (an anti-join); of equal conversations the smallest conv_id stays.  The others are rendered.

The rolling hash is SHA-256 of the hash before and the turn, in the JVM, by an aggregate over the conversation's own turns, so no
group but one conversation is gathered; prefix keys meet by hash and are reduced to distinct ones before the join.

Defined cases: rows with a null conv_id are left out; turns are ordered by turn (nulls first), then role, then text; repeated rows of one
conversation are one turn; a null role or text is different from an empty one and renders as empty; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

START, END = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns in order, hashes after each turn."""
    item = F.struct("turn", "role", "text")
    said = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_set(item)).alias("turns"))
    part = lambda c: F.coalesce(F.concat(F.lit("+"), F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    start = F.array().cast("array<string>")
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))
    hashes = F.aggregate("turns", start, lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat(last(acc), part(x["role"]), part(x["text"])).cast("binary"), 256))))
    return said.withColumn("hashes", hashes)


def maximal(turns: DataFrame) -> DataFrame:
    """Conversations that are no proper prefix of another; of equal ones the smallest conv_id. conv_id, turns, n_copies."""
    talks = stored(conversations(turns), "conversations")
    ends = talks.select("conv_id", F.size("turns").alias("n"), F.element_at("hashes", -1).alias("last"))
    classes = stored(ends.groupBy("n", "last").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies")), "classes")
    heads = talks.join(classes.select("conv_id"), "conv_id", "left_semi")
    prefixes = heads.select(F.explode(F.slice("hashes", F.lit(1), F.size("hashes") - 1)).alias("last")).distinct()
    return talks.join(classes.join(prefixes, "last", "left_anti").select("conv_id", "n_copies"), "conv_id").drop("hashes")


def render(talks: DataFrame) -> DataFrame:
    """One training string for each conversation: every turn between markers with its role."""
    line = F.transform("turns", lambda x: F.concat(F.lit(START), F.coalesce(x["role"], F.lit("")), F.lit("\n"), F.coalesce(x["text"], F.lit("")), F.lit(END)))
    return talks.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", F.array_join(line, "\n").alias("chat"))


def op4_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(maximal(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


OP4_SQL = """
WITH t AS (
  SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id
), k AS (
  SELECT conv_id, turns, len(turns) AS n, list_transform(turns, lambda x: struct_pack(role := x.role, text := x.text)) AS said FROM t
), c AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, said, n FROM k GROUP BY said, n
), p AS (SELECT DISTINCT said[1 : i] AS said FROM (SELECT said, unnest(range(1, n)) AS i FROM c))
SELECT c.conv_id, CAST(c.n AS BIGINT) AS n_turns, c.n_copies,
  array_to_string(list_transform(c.said, lambda x: '<|im_start|>' || coalesce(x.role, '') || chr(10) || coalesce(x.text, '') || '<|im_end|>'), chr(10)) AS chat
FROM c LEFT JOIN p ON p.said = c.said WHERE p.said IS NULL
"""
