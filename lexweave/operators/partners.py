"""Comparisons of word pairs over their common partners, by tiles of words.

A word's partners become one dense row: a level for each partner and the logarithm of its score.  Rows are dealt to tiles of
SIDE by SIDE words; within a tile, common partners and equal levels are products of blocks.  The join of the index with itself
on the partner, which has the cube of the vocabulary as rows, is never made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import written

SIDE = 256
#: Level of a partner that is none.
NONE = 255

ROWS = T.StructType([
    T.StructField("corpus", T.StringType()), T.StructField("w", T.IntegerType()),
    T.StructField("levels", T.BinaryType()), T.StructField("logs", T.BinaryType()),
])
KEYS = [T.StructField("corpus", T.StringType()), T.StructField("idx_a", T.IntegerType()), T.StructField("idx_b", T.IntegerType())]
Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def dense(index: DataFrame) -> DataFrame:
    """corpus, w and the word's partners by number: levels (8 bits) and log1p of scores (64 bits)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for corpus, w, width, partners in batch.itertuples(index=False, name=None):
                levels, logs = np.full(width, NONE, dtype=np.uint8), np.zeros(width)
                for x in partners:
                    if x["tl"] >= NONE:
                        raise ValueError(f"level {x['tl']} is too deep")
                    levels[x["partner"]], logs[x["partner"]] = x["tl"], np.log1p(x["sod"])
                rows.append((corpus, w, levels.tobytes(), logs.tobytes()))
            yield pd.DataFrame(rows, columns=ROWS.names)

    widths = index.groupBy("corpus").agg((F.max(F.greatest("w", "partner")) + 1).alias("width"))
    rows = index.groupBy("corpus", "w").agg(F.collect_list(F.struct("partner", "sod", "tl")).alias("partners"))
    return rows.join(widths, "corpus").select("corpus", F.col("w").cast("int").alias("w"), "width", "partners").mapInPandas(run, ROWS)


def by_tiles(index: DataFrame, kernel: Callable[[Block, Block], dict[str, np.ndarray]], fields: list[T.StructField]) -> DataFrame:
    """What kernel gives of each tile: for words of two blocks, columns with places of a and b among them."""
    schema = T.StructType([*KEYS, *fields])
    rows = written(dense(index).withColumn("block", F.floor(F.col("w") / SIDE).cast("int")), "dense")
    blocks = rows.groupBy("corpus").agg(F.sort_array(F.collect_set("block")).alias("blocks"))
    dealt = rows.join(blocks, "corpus").select("corpus", "w", "levels", "logs", "block", F.explode("blocks").alias("other"))
    names = ("corpus", "block", "other", "w", "levels", "logs")
    left = dealt.where("block <= other").select(*(F.col(c).alias(f"a_{c}") for c in names))
    right = dealt.where("other <= block").select(*(F.col(c).alias(f"b_{c}") for c in names))

    def block(part: pd.DataFrame, side: str) -> Block:
        def stack(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(part[f"{side}_{name}"]), kind).reshape(len(part), -1)

        return part[f"{side}_w"].to_numpy(), stack("levels", np.uint8), stack("logs", np.float64)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=schema.names)
        one, two = block(a, "a"), block(b, "b")
        out = kernel(one, two)
        x, y = out.pop("a"), out.pop("b")
        frame = pd.DataFrame({"corpus": a["a_corpus"].iloc[0], "idx_a": one[0][x], "idx_b": two[0][y], **out})
        return frame[frame["idx_a"] < frame["idx_b"]][schema.names]

    return left.groupBy("a_corpus", "a_block", "a_other").cogroup(right.groupBy("b_corpus", "b_other", "b_block")).applyInPandas(run, schema)


def _levels(*blocks: Block) -> list[int]:
    found = np.unique(np.concatenate([np.unique(x[1]) for x in blocks]))
    return found[found != NONE].tolist()


def _count(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many partners two words share, from their marks: whole numbers below 2 ** 24 are exact."""
    return np.rint(a.astype(np.float32) @ b.T.astype(np.float32)).astype(np.int64)


def confusion(one: Block, two: Block) -> dict[str, np.ndarray]:
    parts = []
    for la in _levels(one):
        for lb in _levels(two):
            n = _count(one[1] == la, two[1] == lb)
            a, b = np.nonzero(n)
            parts.append((a, b, np.full(a.size, la), np.full(a.size, lb), n[a, b]))
    return dict(zip(("a", "b", "level_a", "level_b", "n"), map(np.concatenate, zip(*parts, strict=True)), strict=True))


def matches(one: Block, two: Block) -> dict[str, np.ndarray]:
    parts = []
    for level in _levels(one):
        mark = one[1] == level
        total, same = _count(mark, two[1] != NONE), _count(mark, two[1] == level)
        a, b = np.nonzero(total)
        parts.append((a, b, np.full(a.size, level), total[a, b], same[a, b]))
    return dict(zip(("a", "b", "level_a", "total", "matching"), map(np.concatenate, zip(*parts, strict=True)), strict=True))


def differences(one: Block, two: Block) -> dict[str, np.ndarray]:
    parts = []
    for k in range(one[0].size):
        both = (one[1][k] != NONE) & (two[1] != NONE)
        n = both.sum(axis=1)
        b = np.flatnonzero(n)
        logs = (np.abs(one[2][k] - two[2][b]) * both[b]).sum(axis=1) / n[b]
        levels = (np.abs(one[1][k].astype(np.int16) - two[1][b].astype(np.int16)) * both[b]).sum(axis=1) / n[b]
        parts.append((np.full(b.size, k), b, logs, levels))
    return dict(zip(("a", "b", "s", "t"), map(np.concatenate, zip(*parts, strict=True)), strict=True))
