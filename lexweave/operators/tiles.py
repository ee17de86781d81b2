"""Pair scores by tiles of words.

All pairs of a lexicon are a square of words by words.  It is cut into tiles of SIDE by SIDE words (fewer where the vocabulary
is so large that a tile's walk counts would pass CELLS numbers), and each tile is one row of work that carries its lexicon: a
dictionary is a few megabytes, its pairs are not.  Within a tile walk counts and distances are dense blocks.  Levels are
stepped from 0 on; a pair whose termination level can no longer fall is settled, its score taken by one product of blocks, and
the tile ends with its last pair.  No table between words, levels and pairs is ever made.

Counts are exact: in floating point while every sum stays below 2 ** 53, else in whole numbers; a score that leaves 64 bits
is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, CELLS = 512, 1 << 24
#: Distance of words that are not reached, and the deepest level.
NEVER, MOST = 255, 100
EXACT = 2.0**53

PAIRS = T.StructType([
    T.StructField("corpus", T.StringType()), T.StructField("idx1", T.IntegerType()), T.StructField("idx2", T.IntegerType()),
    T.StructField("sod", T.LongType()), T.StructField("tl", T.IntegerType()), T.StructField("god", T.IntegerType()),
])
SAME = T.StructType([
    T.StructField("combo", T.StringType()), T.StructField("word", T.StringType()),
    T.StructField("sod", T.LongType()), T.StructField("tl", T.IntegerType()),
])


class Graph:
    """Edges (head, tok, how often) over words by number, sorted by tok."""

    def __init__(self, names: dict[str, int], definitions: list[tuple[str, list[str]]]):
        heads = np.array([names[h] for h, d in definitions for _ in d], dtype=np.int64)
        toks = np.array([names[t] for _, d in definitions for t in d], dtype=np.int64)
        both, self.mult = np.unique(toks * len(names) + heads, return_counts=True)
        self.n, self.heads, toks = len(names), both % len(names), both // len(names)
        self.toks, self.starts = np.unique(toks, return_index=True)

    def step(self, level: np.ndarray) -> np.ndarray:
        """Walk counts of the next level from those of a level, (words of a block, all words)."""
        out = np.zeros_like(level)
        if self.toks.size:
            for at in range(0, len(level), 32):  # bounds what is held for the edges
                part = level[at : at + 32][:, self.heads] * self.mult.astype(level.dtype)
                out[at : at + 32, self.toks] = np.add.reduceat(part, self.starts, axis=1)
        return out

    def distances(self, seeds: np.ndarray) -> np.ndarray:
        out = np.full((seeds.size, self.n), NEVER, dtype=np.uint8)
        front = np.zeros((seeds.size, self.n), dtype=bool)
        front[np.arange(seeds.size), seeds] = True
        for d in range(MOST + 1):
            out[front] = d
            if not self.toks.size or not front.any():
                break
            ahead = np.zeros_like(front)
            for at in range(0, seeds.size, 32):
                ahead[at : at + 32, self.toks] = np.logical_or.reduceat(front[at : at + 32][:, self.heads], self.starts, axis=1)
            front = ahead & (out == NEVER)
        return out


def _identity(seeds: np.ndarray, n: int, dtype: type) -> np.ndarray:
    out = np.zeros((seeds.size, n), dtype=dtype)
    out[np.arange(seeds.size), seeds] = 1
    return out


def _least(value: object) -> int:
    if not -(2**63) <= int(value) < 2**63:
        raise OverflowError(f"the score {value} leaves 64 bits")
    return int(value)


def tile(graph: Graph, a: np.ndarray, b: np.ndarray, dtype: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, termination level and depth of every pair of the words a and b, by number; scores of -1 did not end."""
    far = 1 << 20
    to_a, to_b = graph.distances(a), graph.distances(b)
    god = np.zeros((a.size, b.size), dtype=np.int64)
    for k in range(a.size):
        nearest = np.minimum(to_a[k], to_b)
        god[k] = np.where(nearest == NEVER, 0, nearest).max(axis=1)
    god = np.minimum(god + 1, MOST)
    score, best = np.zeros(god.shape, dtype=dtype), np.full(god.shape, far, dtype=np.int64)
    walks = [_identity(a, graph.n, dtype), _identity(b, graph.n, dtype)]
    sums = [np.zeros_like(w) for w in walks]
    for level in range(int(god.max(initial=0)) + 2):
        if level:
            walks = [graph.step(w) for w in walks]
            for s, w in zip(sums, walks, strict=True):
                s += level * w
            if dtype is np.float64 and max((float(s.sum(axis=1).max(initial=0)) for s in sums), default=0.0) >= EXACT / 4:
                return tile(graph, a, b, object)
        for side, (w, other) in enumerate(zip(walks, (to_b, to_a), strict=True)):
            for k in range(len(w)):
                support = np.flatnonzero(w[k])
                if support.size:
                    reach = other[:, support].max(axis=1).astype(np.int64)
                    ends = np.maximum(np.where(reach == NEVER, far, reach), max(level, 1))
                    line = best[k] if side == 0 else best[:, k]
                    np.minimum(line, ends, out=line)
        now = best == level
        if now.any():
            score = np.where(now, sums[0] @ (to_b > level).T.astype(dtype) + (sums[1] @ (to_a > level).T.astype(dtype)).T, score)
        if (best <= level).all():
            break
    ended = best <= god + 1
    whole = np.array([_least(x) for x in score[ended]], dtype=np.int64) if dtype is object else score[ended].astype(np.int64)
    out = np.full(god.shape, -1, dtype=np.int64)
    out[ended] = whole
    return out, np.where(ended, best, god + 1), god


def _packed(lexicon: DataFrame) -> DataFrame:
    """One row for each lexicon: its entries. A dictionary's size is that of its vocabulary."""
    entries = F.array_sort(F.collect_list(F.struct("idx", "head", "definition")))
    return lexicon.groupBy("corpus").agg(entries.alias("entries"), F.count("*").alias("n"))


def _names(*entries: list) -> dict[str, int]:
    words = [x["head"] for e in entries for x in e] + [t for e in entries for x in e for t in x["definition"]]
    return {w: k for k, w in enumerate(dict.fromkeys(words))}


def _side(n: str = "n") -> Column:
    """Words of a tile's side: SIDE, less where a block of walk counts would pass CELLS numbers."""
    return F.greatest(F.lit(1), F.least(F.lit(SIDE), F.floor(F.lit(CELLS) / F.greatest(F.col(n), F.lit(1))))).cast("int")


def pair_scores(lexicon: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(corpus, idx1, idx2, sod, tl, god) of all pairs idx1 < idx2 of each lexicon; with pairs (corpus, idx1, idx2), of these."""
    packed = _packed(lexicon).withColumn("side", _side())
    blocks = F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("side")).cast("int") - 1)
    tiles = packed.select("corpus", "side", blocks.alias("blocks")).select("corpus", "side", "blocks", F.explode("blocks").alias("i"))
    tiles = tiles.select("corpus", "side", "i", F.explode("blocks").alias("j")).where("i <= j")
    if pairs is not None:
        wanted = pairs.groupBy("corpus").agg(F.collect_set(F.struct("idx1", "idx2")).alias("wanted"))
        tiles = packed.join(wanted, "corpus").select("corpus", "side", F.lit(0).alias("i"), F.lit(0).alias("j"), "wanted")
    else:
        tiles = tiles.withColumn("wanted", F.lit(None).cast("array<struct<idx1:int,idx2:int>>"))
    work = tiles.join(packed.select("corpus", "entries"), "corpus").repartition("corpus", "i", "j")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, graph, idx, at = None, None, None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.corpus != known:
                    names = _names(row.entries)
                    graph = Graph(names, [(x["head"], x["definition"]) for x in row.entries])
                    idx, at = np.array([x["idx"] for x in row.entries]), np.array([names[x["head"]] for x in row.entries])
                    known = row.corpus
                if row.wanted is None:
                    one, two = (np.arange(k * row.side, min(idx.size, (k + 1) * row.side)) for k in (row.i, row.j))
                    keep = idx[one][:, None] < idx[two][None, :]
                else:
                    asked = {(int(x["idx1"]), int(x["idx2"])) for x in row.wanted}
                    one, two = (np.flatnonzero(np.isin(idx, [x[k] for x in asked])) for k in (0, 1))
                    keep = np.array([[(int(x), int(y)) in asked for y in idx[two]] for x in idx[one]], dtype=bool).reshape(one.size, two.size)
                sod, tl, god = tile(graph, at[one], at[two])
                x, y = np.nonzero(keep)
                yield pd.DataFrame({"corpus": row.corpus, "idx1": idx[one][x], "idx2": idx[two][y], "sod": sod[x, y], "tl": tl[x, y], "god": god[x, y]})

    return work.select("corpus", "side", "i", "j", "wanted", "entries").mapInPandas(run, PAIRS)


def _same(first: Graph, second: Graph, union: Graph, seeds: np.ndarray, dtype: type = np.float64) -> tuple[list[int], list[int]]:
    """Score and termination level of words in two graphs: counts do not multiply, and level 0 does not end."""
    far = 1 << 20
    graphs, reach = (first, second), [g.distances(seeds) for g in (first, second)]
    god = union.distances(seeds)
    god = np.minimum(np.where(god == NEVER, 0, god).max(axis=1).astype(np.int64) + 1, MOST)
    best, score = np.full(seeds.size, far, dtype=np.int64), np.zeros(seeds.size, dtype=dtype)
    level_of = [_identity(seeds, g.n, dtype) for g in graphs]
    sums = [np.zeros_like(w) for w in level_of]
    for level in range(1, int(god.max(initial=0)) + 2):
        level_of = [g.step((w != 0).astype(dtype)) for g, w in zip(graphs, level_of, strict=True)]
        for s, w, other in zip(sums, level_of, reversed(reach), strict=True):
            s += level * w
            there = np.where(w != 0, other.astype(np.int64), -1).max(axis=1)
            np.minimum(best, np.where(there < 0, far, np.maximum(np.where(there == NEVER, far, there), level)), out=best)
        now = best == level
        score[now] = sum((s * (other > level)).sum(axis=1) for s, other in zip(sums, reversed(reach), strict=True))[now]
        if (best <= level).all():
            break
    if dtype is np.float64 and max(float(s.sum(axis=1).max(initial=0)) for s in sums) >= EXACT / 4:
        return _same(first, second, union, seeds, object)
    ended = best <= god + 1
    return [_least(x) if e else -1 for x, e in zip(score, ended, strict=True)], np.where(ended, best, god + 1).tolist()


def same_word_scores(lexicon: DataFrame, combos: DataFrame, words: DataFrame) -> DataFrame:
    """(combo, word, sod, tl) of each word that heads a definition in both corpora of a combination (combo, a, b)."""
    packed = _packed(lexicon)
    one, two = (packed.select(F.col("corpus").alias(c), F.col("entries").alias(f"entries_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
    pairs = combos.join(one, "a").join(two, "b").withColumn("n", F.col("n_a") + F.col("n_b")).withColumn("side", _side())
    heads = lexicon.join(words.select(F.col("word").alias("head")), "head", "left_semi").select(F.col("corpus").alias("a"), "head").distinct()
    other = lexicon.select(F.col("corpus").alias("b"), "head").distinct()
    both = combos.join(heads, "a").join(other, ["b", "head"]).select("combo", F.col("head").alias("word"))
    blocks = both.join(pairs.select("combo", "side", "n"), "combo")
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("word"), F.ceil(F.col("n") / F.col("side")))).groupBy("combo", "block").agg(F.sort_array(F.collect_list("word")).alias("seeds"))
    work = blocks.join(pairs.select("combo", "entries_a", "entries_b"), "combo").repartition("combo", "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                names = _names(row.entries_a, row.entries_b)
                sides = [[(x["head"], x["definition"]) for x in e] for e in (row.entries_a, row.entries_b)]
                graphs = [Graph(names, s) for s in (*sides, sides[0] + sides[1])]
                sod, tl = _same(*graphs, np.array([names[w] for w in row.seeds]))
                yield pd.DataFrame({"combo": row.combo, "word": list(row.seeds), "sod": sod, "tl": tl})

    return work.select("combo", "block", "seeds", "entries_a", "entries_b").mapInPandas(run, SAME)
