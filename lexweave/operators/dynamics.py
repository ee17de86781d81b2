"""Guided walks over spectra, and their statistics.

A walk's path needs only its words' sets, so paths are walked first, each in one task: chains beside the first bins of their
corpus (a hundredth of its pairs, the same for every walk), sweeps beside the bins of their two start words.  Scores and
percentiles come to the steps in one join afterwards.  A pick is the md5 of the seed, the step, the side and the walk's keys,
modulo the sorted pool, so runs repeat and SQL can check them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import written

# Start percentiles, the last level of histograms.
START_PERCENTILES = (1, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75, 80, 85, 90, 95, 100)
MAX_TL = 25
#: Edges of the score histogram: 0, then ten to a decade from 1 to 10 ** 8.
SOD_EDGES = [0.0, *(10 ** (k / 10) for k in range(81))]
KEYS = ["corpus", "start_pctl", "variant", "a", "b", "traj"]
#: Tasks that the chains of a corpus are dealt to.
PARTS = 16
BINS = 100
PATH = T.StructType([
    T.StructField("corpus", T.StringType()), T.StructField("start_pctl", T.IntegerType()), T.StructField("variant", T.StringType()),
    *[T.StructField(c, T.IntegerType()) for c in ("a", "b", "traj", "step", "cur_a", "cur_b")], T.StructField("death", T.StringType()),
])


def start_pairs(mutual: DataFrame, trajectories: int, percentiles: tuple[int, ...] = START_PERCENTILES) -> DataFrame:
    """Chains from mutual pairs of each start percentile, sweeps from those of the first; each `trajectories` times."""
    some = mutual.where(F.col("bin").isin(*percentiles)).select("corpus", F.col("bin").alias("start_pctl"), "a", "b")
    both = some.withColumn("variant", F.lit("chain")).unionByName(some.where("start_pctl = 1").withColumn("variant", F.lit("sweep")))
    return both.withColumn("traj", F.explode(F.sequence(F.lit(0), F.lit(trajectories - 1)))).select(*KEYS)


def pick(pool: list[int], seed: int, step: int, side: str, keys: str) -> int:
    """One of a sorted pool."""
    return pool[int(hashlib.md5(f"{seed}|{step}|{side}|{keys}".encode()).hexdigest()[:8], 16) % len(pool)]


def _death(pool_a: list[int], pool_b: list[int]) -> str | None:
    return None if pool_a and pool_b else "pool_b" if pool_a else "pool_a" if pool_b else "both"


def chain(keys: tuple, sets: dict[int, list[int]], max_steps: int, seed: int) -> Iterator[tuple]:
    """Steps of a walk whose walkers go to partners in the first bin of their word, not used by the other walker, rather ones
    that have such a bin themselves."""
    a, b = keys[3], keys[4]
    name, used_a, used_b = "|".join(map(str, keys)), {a}, {b}
    yield 0, a, b, None
    for step in range(1, max_steps + 1):
        if not sets.get(a) or not sets.get(b):
            yield step, None, None, "no_bin"
            return
        pools = []
        for at, used in ((a, used_b), (b, used_a)):
            left = [x for x in sets[at] if x not in used]
            pools.append([x for x in left if x in sets] or left)
        if death := _death(*pools):
            yield step, None, None, death
            return
        a, b = pick(pools[0], seed, step, "a", name), pick(pools[1], seed, step, "b", name)
        used_a.add(a)
        used_b.add(b)
        yield step, a, b, None


def sweep(keys: tuple, bins_a: dict[int, list[int]], bins_b: dict[int, list[int]], max_steps: int, seed: int) -> Iterator[tuple]:
    """Steps of a walk that picks from one bin of the two start words after another."""
    name, used_a, used_b = "|".join(map(str, keys)), set(), set()
    for step in range(min(BINS, max_steps + 1)):
        pool_a, pool_b = [x for x in bins_a.get(step + 1, ()) if x not in used_b], [x for x in bins_b.get(step + 1, ()) if x not in used_a]
        if death := _death(pool_a, pool_b):
            yield step, None, None, death
            return
        a, b = pick(pool_a, seed, step, "a", name), pick(pool_b, seed, step, "b", name)
        used_a.add(a)
        used_b.add(b)
        yield step, a, b, None


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=PATH.names)
    return out.astype({"cur_a": "Int32", "cur_b": "Int32"})


def paths(starts: DataFrame, bins: DataFrame, max_steps: int, seed: int) -> DataFrame:
    """(keys, step, cur_a, cur_b, death) of each walk's steps; the words are null where it died."""
    first = bins.where("bin = 1").groupBy("corpus", "w").agg(F.sort_array(F.collect_list("partner")).alias("set"))
    every = first.select(F.col("corpus").alias("of"), "w", "set", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("for_part"))
    chains = starts.where("variant = 'chain'").withColumn("part", F.pmod(F.xxhash64(*KEYS), F.lit(PARTS)).cast("int"))

    def walk_chains(walks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        sets = {int(w): [int(x) for x in s] for w, s in zip(rows["w"], rows["set"], strict=True)}
        return _frame([(*keys, *x) for keys in walks[KEYS].itertuples(index=False, name=None) for x in chain(keys, sets, max_steps, seed)])

    def walk_sweeps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *keys, trajectories, set_a, set_b in batch.itertuples(index=False, name=None):
                sides = [{x["bin"]: [int(y) for y in x["set"]] for x in s} for s in (set_a, set_b)]
                for t in trajectories:
                    rows += [(*keys, int(t), *x) for x in sweep((*keys, int(t)), *sides, max_steps, seed)]
            yield _frame(rows)

    per = bins.groupBy("corpus", "w", "bin").agg(F.sort_array(F.collect_list("partner")).alias("set"))
    per = written(per.groupBy("corpus", "w").agg(F.collect_list(F.struct("bin", "set")).alias("bins")), "bins")
    pairs = starts.where("variant = 'sweep'").groupBy(*KEYS[:-1]).agg(F.sort_array(F.collect_list("traj")).alias("trajectories"))
    for side in "ab":
        pairs = pairs.join(per.select("corpus", F.col("w").alias(side), F.col("bins").alias(f"bins_{side}")), ["corpus", side])
    sweeps = pairs.select(*KEYS[:-1], "trajectories", "bins_a", "bins_b").mapInPandas(walk_sweeps, PATH)
    walked = chains.groupBy("corpus", "part").cogroup(every.groupBy("of", "for_part")).applyInPandas(walk_chains, PATH)
    return walked.unionByName(sweeps)


def walk(starts: DataFrame, bins: DataFrame, ranked: DataFrame, max_steps: int = 100, seed: int = 0) -> DataFrame:
    """(keys, step, sod, tl, pctl_a, pctl_b, prev_sod, death) of each walk's steps. bins: corpus, w, partner, bin; ranked: corpus, w,
    partner, sod, tl, pctl (null: 1). A step whose words are no scored pair has null scores and percentiles of -1."""
    steps = written(paths(starts, bins, max_steps, seed), "paths")
    rank = F.coalesce("pctl", F.lit(1))
    one = ranked.select("corpus", F.col("w").alias("cur_a"), F.col("partner").alias("cur_b"), "sod", "tl", rank.alias("pctl_a"))
    other = ranked.select("corpus", F.col("partner").alias("cur_a"), F.col("w").alias("cur_b"), rank.alias("pctl_b"))
    scored = steps.join(one.join(other, ["corpus", "cur_a", "cur_b"]), ["corpus", "cur_a", "cur_b"], "left")
    previous = F.lag("sod").over(Window.partitionBy(*KEYS).orderBy("step")).alias("prev_sod")
    none = F.lit(-1)
    return scored.select(*KEYS, "step", "sod", "tl", F.coalesce("pctl_a", none).alias("pctl_a"), F.coalesce("pctl_b", none).alias("pctl_b"), previous, "death")


def dynamics_stats(steps: DataFrame) -> DataFrame:
    """Sums over walks for each start percentile, variant and step; one row to a key."""
    went = F.col("death").isNull()
    value = lambda c, ok=went: F.when(ok, F.col(c).cast("double"))
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0.0)).alias(name)
    sod, tl, pa, pb = value("sod"), value("tl"), value("pctl_a", went & (F.col("pctl_a") >= 0)), value("pctl_b", went & (F.col("pctl_b") >= 0))
    log, delta = F.when(sod > 0, F.log(sod)), sod - F.col("prev_sod").cast("double")
    columns = [total(sod, "sod_sum"), total(sod * sod, "sod_sq_sum"), total(tl, "tl_sum"), total(tl * tl, "tl_sq_sum"), total(pa, "pctl_a_sum"), total(pa * pa, "pctl_a_sq_sum"), total(pb, "pctl_b_sum"), total(pb * pb, "pctl_b_sq_sum"), total(sod * tl, "sod_tl_sum"), total(pa * pb, "pctl_ab_sum"), total(log, "log_sod_sum"), total(log * log, "log_sod_sq_sum"), total(delta, "delta_sod_sum"), total(delta * delta, "delta_sod_sq_sum"), F.count(delta).alias("delta_sod_count")]
    deaths = [F.count_if(F.col("death") == d).alias(f"death_{d}") for d in ("pool_a", "pool_b", "both", "no_bin")]
    return steps.groupBy("corpus", "start_pctl", "variant", "step").agg(F.count_if(went).alias("count"), *columns, *deaths)


def dynamics_hist(steps: DataFrame) -> DataFrame:
    """(corpus, start_pctl, variant, step, hist_type, bin_idx, bin_count): levels, percentiles and log-spaced scores by step; walk lengths at step -1."""
    by = ["corpus", "start_pctl", "variant"]
    edges = F.array(*[F.lit(e) for e in SOD_EDGES])
    sod_bin = F.least(F.size(F.filter(edges, lambda e: e <= F.col("sod"))) - 1, F.lit(len(SOD_EDGES) - 2))
    parts = F.array(*[F.struct(F.lit(n).alias("hist_type"), c.cast("int").alias("bin_idx")) for n, c in (("tl", F.least("tl", F.lit(MAX_TL))), ("pctl_a", F.when(F.col("pctl_a") >= 1, F.col("pctl_a"))), ("pctl_b", F.when(F.col("pctl_b") >= 1, F.col("pctl_b"))), ("sod", sod_bin))])
    rows = steps.where("death IS NULL AND sod IS NOT NULL").select(*by, "step", F.explode(parts).alias("h")).select(*by, "step", "h.*").where("bin_idx IS NOT NULL")
    lengths = steps.groupBy(*KEYS).agg(F.count_if(F.col("death").isNull()).cast("int").alias("bin_idx")).select(*by, F.lit(-1).alias("step"), F.lit("walk_len").alias("hist_type"), "bin_idx")
    return rows.unionByName(lengths).groupBy(*by, "step", "hist_type", "bin_idx").agg(F.count("*").alias("bin_count"))
