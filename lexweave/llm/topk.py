"""Exact top-k inner products by a vector-approximation file.

1. Rows get an id of their own.  Equal vectors are one class from here on: only a class's k + 1 smallest vec_ids can be
   in an answer, so copies cost nothing, however many there are.
2. The approximation file, a stored table, holds for each class a cell of CELL_BITS bits for each component, cut from the
   vector's own largest component on.  Exact vectors are stored beside it and not read by the scan.
3. The stated queries meet all classes in a grid of blocks.  A task scans cells alone: q . lower edge, and the cell width
   times the sums of q's positive and negative parts, bound each score from both sides (in floating point, widened by its
   rounding).  Classes whose upper bound reaches the block's (k + 1)-th largest lower bound remain.
4. By query, classes whose upper bound is below the (k + 1)-th largest lower bound of all blocks go.  Exact vectors are
   then read in order of upper bounds: FIRST * (k + 1) of them, then only those that may still beat the (k + 1)-th exact
   score, which makes the result certain.
5. Classes become rows again, and a query's own row is left out.

Memory of a task is bounded by QUERY_BLOCK exact and CANDIDATE_BLOCK approximate vectors, spread by hash of the class.

Defined cases: rows whose vec_id or vector is null, or with a null or non-finite component, take no part; rows that
repeat a vec_id are queries and candidates each for itself, and only the query's own row is left out; ties go to the
smaller vec_id; vectors of different lengths are not compared; a component of 2 ** 56 or more, or a score that leaves 64
bits, ends the query with a message, as no result of the stated type exists; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_map, small_batches, stored, table

CELL_BITS, QUERY_BLOCK, CANDIDATE_BLOCK = 6, 8192, 16_384
#: Queries whose bounds a task holds at once.
CHUNK = 128
#: Exact vectors read before the first certain bound, times k + 1.
FIRST = 2

HEADS = T.StructType([
    T.StructField("cid", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("exact", T.BinaryType()),
    T.StructField("shift", T.IntegerType()), T.StructField("cells", T.BinaryType()),
])
BOUNDS = T.StructType([
    T.StructField("qid", T.LongType()), T.StructField("cid", T.LongType()),
    T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType()),
])
SCORES = T.StructType([T.StructField(c, T.LongType()) for c in ("qid", "cid", "score")])


def approximate(vector: np.ndarray) -> tuple[int, bytes]:
    """Shift and cells of a vector of 64-bit integers: a component lies in [cell << shift, (cell + 1) << shift)."""
    most = max(int(vector.max(initial=0)), -int(vector.min(initial=0)))
    shift = max(0, most.bit_length() + 1 - CELL_BITS)
    return shift, (vector >> shift).astype(np.int8).tobytes()


def approximation(heads: DataFrame) -> DataFrame:
    """cid, dim, the exact vector and its cells as bytes, of each class (cid, v)."""
    small_batches(heads.sparkSession)
    schema = to_arrow_schema(HEADS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            offsets, flat = column.offsets.to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
            vectors = [flat[a:b] for a, b in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True)]
            cells = [approximate(v) for v in vectors]
            yield pa.RecordBatch.from_pydict({
                "cid": batch.column("cid"), "dim": [v.size for v in vectors], "exact": [v.astype("<i8").tobytes() for v in vectors],
                "shift": [s for s, _ in cells], "cells": [c for _, c in cells],
            }, schema=schema)

    return heads.select("cid", "v").mapInArrow(run, HEADS)


def scan(queries: np.ndarray, cells: np.ndarray, shift: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Query places, candidate places, lower and upper bounds that remain, for a chunk of queries at a time.

    What remains reaches the query's `most`-th largest lower bound."""
    width = np.ldexp(1.0, shift.astype(np.int64)) - 1
    low = cells.astype(np.float64) * np.ldexp(1.0, shift.astype(np.int64))[:, None]
    size, dim = np.abs(low).sum(axis=1), max(1, cells.shape[1])
    for at in range(0, len(queries), CHUNK):
        q = queries[at : at + CHUNK].astype(np.float64)
        near = q @ low.T
        largest = np.abs(q).max(axis=1, initial=0)[:, None]
        slack = (dim + 8) * 2.0**-52 * largest * (size + dim * (width + 1))[None, :]
        lower = near + np.minimum(q, 0).sum(axis=1)[:, None] * width - slack
        upper = near + np.maximum(q, 0).sum(axis=1)[:, None] * width + slack
        nth = min(most, len(cells))
        cut = np.partition(lower, len(cells) - nth, axis=1)[:, len(cells) - nth]
        row, column = np.nonzero(upper >= cut[:, None])
        yield at + row, column, lower[row, column], upper[row, column]


def exact_scores(queries: list[bytes], vectors: list[bytes]) -> list[int]:
    """Inner products of pairs of exact vectors, in wider integers where 64 bits may not hold them."""
    out = []
    for q, v in zip(queries, vectors, strict=True):
        a, b = np.frombuffer(q, "<i8"), np.frombuffer(v, "<i8")
        bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.size)
        score = int(a @ b) if bound < 2**62 else sum(x * y for x, y in zip(a.tolist(), b.tolist(), strict=True))
        if not -(2**63) <= score < 2**63:
            raise OverflowError(f"the score {score} leaves 64 bits")
        out.append(score)
    return out


def _scored(pairs: DataFrame, queries: DataFrame, heads: DataFrame) -> DataFrame:
    """qid, cid, score of pairs, from the exact vectors of these pairs alone."""

    def make():
        return lambda rows: {"qid": rows["qid"], "cid": rows["cid"], "score": exact_scores(rows["q"], rows["exact"])}

    both = pairs.select("qid", "cid").join(heads.select("cid", "exact"), "cid")
    return arrow_map(both.join(queries.select("qid", F.col("exact").alias("q")), "qid").select("qid", "cid", "q", "exact"), make, SCORES)


def _remaining(queries: DataFrame, n_queries: int, heads: DataFrame, n_heads: int, most: int) -> DataFrame:
    """qid, cid, lower, upper that a scan of the cells leaves, block by block."""
    blocks, groups = max(1, -(-n_heads // CANDIDATE_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def placed(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    asked = queries.select("dim", placed("qid", groups).alias("qb"), each(blocks).alias("cb"), "qid", "exact")
    cells = heads.select("dim", each(groups).alias("qb"), placed("cid", blocks).alias("cb"), "cid", "shift", "cells")

    def block(q: pd.DataFrame, c: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if q.empty or c.empty:
            return
        dim = int(q["dim"].iloc[0])
        exact = np.frombuffer(b"".join(q["exact"]), "<i8").reshape(len(q), dim)
        near = np.frombuffer(b"".join(c["cells"]), np.int8).reshape(len(c), dim)
        qid, cid = q["qid"].to_numpy(), c["cid"].to_numpy()
        for row, column, lower, upper in scan(exact, near, c["shift"].to_numpy(), most):
            yield pd.DataFrame({"qid": qid[row], "cid": cid[column], "lower": lower, "upper": upper})

    def whole(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        parts = list(block(q, c))
        return pd.concat(parts) if parts else pd.DataFrame(columns=BOUNDS.names)

    return asked.groupBy("dim", "qb", "cb").cogroup(cells.groupBy("dim", "qb", "cb")).applyInPandas(whole, BOUNDS)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score from vectors (vec_id, v: array of bigint); is_query is a condition on vec_id."""
    most = k + 1  # a query's own row may be among the best
    rows = stored(vectors.select("vec_id", "v").withColumn("rid", F.monotonically_increasing_id()), "vectors")
    by = Window.partitionBy("v").orderBy("vec_id", "rid")
    few = rows.withColumn("n", F.row_number().over(by)).where(F.col("n") <= most)
    few = stored(few.withColumn("cid", F.first("rid").over(by)), "classes")
    heads = stored(approximation(few.where("n = 1").select("cid", "v")), "approximation")
    asked = rows.where(is_query).join(few.where("n = 1").select("v", "cid"), "v").select("vec_id", "rid", F.col("cid").alias("qid"))
    asked = stored(asked, "asked")
    queries = stored(heads.join(asked.select(F.col("qid").alias("cid")).distinct(), "cid", "left_semi").withColumnRenamed("cid", "qid"), "queries")

    left = stored(_remaining(queries, queries.count(), heads, heads.count(), most), "bounds")
    low = Window.partitionBy("qid").orderBy(F.desc("lower"))
    cut = left.select("qid", "lower").withColumn("n", F.row_number().over(low)).where(F.col("n") <= most).groupBy("qid").agg(F.min("lower").alias("cut"))
    left = left.join(cut, "qid").where("upper >= cut").select("qid", "cid", "upper")
    best = Window.partitionBy("qid").orderBy(F.desc("upper"), "cid")
    left = stored(left.withColumn("n", F.row_number().over(best)), "left")
    first = stored(_scored(left.where(F.col("n") <= FIRST * most), queries, heads), "first")
    high = Window.partitionBy("qid").orderBy(F.desc("score"))
    sure = first.withColumn("n", F.row_number().over(high)).where(F.col("n") <= most).groupBy("qid").agg(F.min("score").alias("sure"))
    rest = left.where(F.col("n") > FIRST * most).join(sure, "qid").where(F.col("upper") >= F.col("sure").cast("double") * (1 - F.signum("sure") * 2.0**-50))
    scores = stored(first.unionByName(_scored(rest, queries, heads)), "scores")

    members = few.select("cid", "vec_id", "rid")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "rid")
    found = scores.join(members, "cid").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    lists = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "rid", "score"))).alias("best"))
    others = asked.join(lists, "qid").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("best", lambda x: x["rid"] != F.col("rid")), 1, k).alias("best"))
    out = others.select("query_id", F.posexplode("best").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def whole_vectors(embeddings: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, of the rows that take part."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    message = F.lit("a component is too large for a 64-bit score")
    whole = F.transform(
        "embedding",
        lambda x: F.when(F.abs(x.cast("double")) < 2.0**56, F.floor(x.cast("double") * scale)).otherwise(F.raise_error(message).cast("long")),
    )
    return embeddings.where(F.col("vec_id").isNotNull() & ok).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(whole_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), F.col("vec_id") % 20 == 0)


OP5_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e,
    row_number() OVER () AS rid
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
