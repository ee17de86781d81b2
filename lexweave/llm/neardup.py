"""Near-duplicate documents by b-bit MinHash, with links confirmed on full shingle sets.

1. Each text becomes the set of hashes of its word shingles; ROWS * BANDS minima are taken, of each the low
   BITS bits are kept and packed into words, and each band of ROWS minima becomes one band key.
2. Copies with the same word sequence are one class from here on; its smallest doc_id stands for it.
3. Star candidates: in each band bucket every member against the member with the smallest doc_id. The packed
   signatures' bit counts, corrected for chance collisions, drop candidates far below the threshold; full sets
   confirm the others, and components follow.
4. Whole job: a bucket whose members are in more than one component then compares the members outside its largest
   component with all its members of other components; pairs inside a component cannot change the result. The join
   itself decides: after sizes and packed signatures, a pair is taken in its first common band only, and bounded from
   above by the sets' 32-bit cells, so that what leaves the join is links and not candidates. So each candidate pair of
   the bands is decided or already joined, and no bucket is capped.

Known limit: inside that join the members outside a bucket's largest component are compared with its other members pair
by pair. A bucket of documents that are alike but not linked costs the square of its size, though few rows leave the join.

A pair of similarity 0.75 shares no band with probability (1 - 0.75 ** ROWS) ** BANDS = 2.4e-8.

Defined cases: null, empty and blank texts have no shingles and link with nothing; fewer words than a shingle give one
shingle of all words; repeated rows of one doc_id are one member (their texts' sets are each linked); rows with a null
doc_id are kept for themselves with a null component and kept = true; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, documents, stored

WORDS, ROWS, BANDS, BITS = 5, 3, 32, 2
#: 100 * intersection >= PERCENT * union links two sets.
PERCENT = 75
#: Candidates whose estimated similarity is below this are dropped; six standard deviations under the threshold.
LEAST_ESTIMATE = 0.75 - 6 * 0.053
#: Values of a block in which minima are taken, which bounds memory on very long texts.
BLOCK = 4096
#: Cells that a row carries into the buckets, which bounds its size; larger sets go without and are left to the confirmation.
MOST_CELLS = 65536
_MASK = 2**64 - 1

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(0, 2**63)) * 2 + 1
_WORD = [np.uint64(int(x) * 2 + 1) for x in _rng.integers(0, 2**63, 64)]
_A = _rng.integers(0, 2**31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32)
_FOLD = _rng.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = 64 // BITS
#: Signature words.
SIG = -(-ROWS * BANDS // _PLACES)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Powers of _BASE and of its inverse, grown as texts need them.
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    if _powers[0].size < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles: A-Z lowered, words parted by blank, tab, and \\n \\v \\f \\r."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), dtype=np.uint8)
    gap = _SPACE[raw]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    if not edge.size:
        return np.zeros(0, dtype=np.uint64)
    start, end = edge[0::2], edge[1::2]
    _grow(raw.size + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(raw.size + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw] * _powers[0][: raw.size], out=total[1:])
        word = _mix((total[end] - total[start]) * _powers[1][start] + (end - start).astype(np.uint64))
        n = word.size
        k = min(words, n)
        out = word[: n - k + 1] * _WORD[0]
        for j in range(1, k):
            out = out + word[j : n - k + 1 + j] * _WORD[j]
        return np.unique(_mix(out + np.uint64(k if n < words else words)))


def minima(hashes: np.ndarray) -> np.ndarray:
    """ROWS * BANDS minima of permuted 32-bit hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(_A.size, 2**32 - 1, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, x.size, BLOCK):
            out = np.minimum(out, (_A[:, None] * x[None, at : at + BLOCK] + _B[:, None]).min(axis=1))
    return out


def signature(least: np.ndarray) -> list[int]:
    """The low BITS bits of each minimum (of its mixed value), packed into SIG signed 64-bit words."""
    low = _mix(least.astype(np.uint64)) & np.uint64(2**BITS - 1)
    low = np.concatenate((low, np.zeros(SIG * _PLACES - low.size, dtype=np.uint64))).reshape(SIG, _PLACES)
    return np.bitwise_or.reduce(low << (np.arange(_PLACES, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64).tolist()


def band_keys(least: np.ndarray) -> list[int]:
    with np.errstate(over="ignore"):
        folded = (_mix(least.astype(np.uint64) + np.uint64(1)) * _FOLD).reshape(BANDS, ROWS).sum(axis=1)
        return _mix(folded + np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist()


SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("sig", T.ArrayType(T.LongType())), T.StructField("bands", T.ArrayType(T.LongType()))])


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, 128 bits of the shingle set, packed signature and band keys of each row of doc_id, text."""

    def make():
        def batch(rows: dict) -> dict:
            out: dict[str, list] = {f.name: [] for f in SKETCH}
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                hashes = shingles(text)
                if hashes.size:
                    digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
                    least = minima(hashes)
                    row = (doc_id, hashes.size, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), signature(least), band_keys(least))
                else:
                    row = (doc_id, 0, None, None, None, None)
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
            return out

        return batch

    return arrow_map(docs.select("doc_id", "text"), make, SKETCH)


def estimate(a: str, b: str):
    """Collision-corrected similarity of two packed signatures by bit counts: (share of equal values - 2 ** -BITS) / (1 - 2 ** -BITS)."""
    n, low = ROWS * BANDS, sum(1 << (k * BITS) for k in range(_PLACES))
    low = low - 2**64 if low >= 2**63 else low

    def differing(k: int):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        x = reduce(lambda acc, j: acc.bitwiseOR(F.shiftrightunsigned(x, j)), range(1, BITS), x)
        return F.bit_count(x.bitwiseAND(F.lit(low).cast("long")))

    equal = 1 - reduce(lambda acc, k: acc + differing(k), range(1, SIG), differing(0)) / F.lit(float(n))
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


CELLS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("cells", T.ArrayType(T.IntegerType()))])


def set_cells(docs: DataFrame) -> DataFrame:
    """doc_id, n, cells of each row of doc_id, text that has shingles: the distinct 32-bit parts of its shingle hashes, null beyond MOST_CELLS."""

    def make():
        def batch(rows: dict) -> dict:
            out: dict[str, list] = {f.name: [] for f in CELLS}
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                hashes = shingles(text)
                if hashes.size:
                    cells = np.unique(hashes.astype(np.uint32)).view(np.int32) if hashes.size <= MOST_CELLS else None
                    for column, value in zip(out.values(), (doc_id, hashes.size, cells), strict=True):
                        column.append(value)
            return out

        return batch

    return arrow_map(docs.select("doc_id", "text"), make, CELLS)


def may_link(x: str, y: str):
    """False only where the sets cannot link. Shared cells and the shingles that fell into another's cell bound the intersection from above."""
    n_x, n_y, cells_x, cells_y = (F.col(f"{k}_{side}") for k in ("n", "cells") for side in (x, y))
    both = F.size(F.array_intersect(cells_x, cells_y)) + F.least(n_x - F.size(cells_x), n_y - F.size(cells_y))
    return cells_x.isNull() | cells_y.isNull() | ((100 + PERCENT) * both >= PERCENT * (n_x + n_y))


PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of distinct pairs a < b, those whose full sets link; the texts come to the pairs, sorted by a, whose set is kept between rows."""
    left, right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def make():
        sets = lru_cache(maxsize=64)(shingles)

        def batch(rows: dict) -> dict:
            a, b = [], []
            for x, y, text_x, text_y in zip(rows["a"], rows["b"], rows["text_a"], rows["text_b"], strict=True):
                one, other = sets(text_x), sets(text_y)
                small, large = min(one.size, other.size), max(one.size, other.size)
                if 100 * small < PERCENT * large:
                    continue
                both = np.intersect1d(one, other, assume_unique=True).size
                if 100 * both >= PERCENT * (one.size + other.size - both):
                    a.append(x)
                    b.append(y)
            return {"a": a, "b": b}

        return batch

    return arrow_map(pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b"), make, PAIR)


def components(links: DataFrame) -> DataFrame:
    """v, c: the smallest vertex reachable from each vertex of links (a, b). Labels flow along links and through their own
    labels until none changes; each round is a written table."""
    edges = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    labels = stored(edges.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("c")), "labels")
    while True:
        flow = edges.join(labels.select(F.col("v").alias("u"), "c"), "u").groupBy("v").agg(F.min("c").alias("n"))
        near = labels.join(flow, "v").select("v", F.col("c").alias("old"), F.least("c", "n").alias("m"))
        jump = labels.select(F.col("v").alias("m"), F.col("c").alias("j"))
        labels = stored(near.join(jump, "m", "left").select("v", F.least("m", F.coalesce("j", "m")).alias("c"), "old"), "labels")
        if labels.where("c <> old").isEmpty():
            return labels.select("v", "c")
        labels = labels.select("v", "c")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of its component), kept, for each row of doc_id, text."""
    docs = docs.select("doc_id", "text")
    rows = stored(sketch(docs), "sketches")
    classes = stored(rows.where("k1 IS NOT NULL AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    ids = stored(rows.where("k1 IS NOT NULL AND doc_id IS NOT NULL").select("k1", "k2", "doc_id").join(classes, ["k1", "k2"]).select("doc_id", "rep"), "members")
    heads = classes.select(F.col("rep").alias("doc_id"), "k1", "k2").join(rows, ["doc_id", "k1", "k2"]).dropDuplicates(["k1", "k2"])
    heads = stored(heads.select("doc_id", F.col("n_shingles").alias("n"), "sig", "bands"), "heads")
    sigs = heads.select("doc_id", "n", "sig")
    banded = heads.select("doc_id", F.explode("bands").alias("band"))
    shared = stored(banded.groupBy("band").agg(F.min("doc_id").alias("a"), F.count("*").alias("members")).where("members > 1"), "buckets")
    members = stored(banded.join(shared.select("band", "a"), "band"), "bucketed")

    def screened(pairs: DataFrame) -> DataFrame:
        """Pairs that sizes and packed signatures leave."""
        a, b = (sigs.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab")
        both = pairs.join(b, "b").join(a, "a")
        return both.where((100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")) & (estimate("sig_a", "sig_b") >= LEAST_ESTIMATE)).select("a", "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "pairs")
        needed = stored(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "needed")
        texts = docs.join(needed, "doc_id", "left_semi")
        return confirm(pairs, texts)

    star = members.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    links = stored(confirmed(screened(star)), "links")
    found = components(links)
    # Buckets that still hold more than one component.
    placed = members.select("band", "doc_id").join(found, F.col("doc_id") == F.col("v"), "left").select("band", "doc_id", F.coalesce("c", "doc_id").alias("c"))
    mixed = placed.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("band")
    placed = stored(placed.join(mixed, "band", "left_semi"), "placed")
    main = placed.groupBy("band", "c").count().groupBy("band").agg(F.max_by("c", "count").alias("main"))
    outside = stored(placed.join(main, "band").where("c <> main"), "outside").select("band", F.col("doc_id").alias("x"), F.col("c").alias("cx"), "main")
    sets = stored(set_cells(docs.join(stored(placed.select("doc_id").distinct(), "wanted"), "doc_id", "left_semi")).dropDuplicates(["doc_id", "n", "cells"]), "cells")
    full = heads.join(sets, ["doc_id", "n"])
    s, t = (full.select(F.col("doc_id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n", "sig", "bands", "cells"))) for k in "xy")
    xs, ys = outside.join(s, "x"), placed.select("band", F.col("doc_id").alias("y"), F.col("c").alias("cy")).join(t, "y")
    near = (100 * F.least("n_x", "n_y") >= PERCENT * F.greatest("n_x", "n_y")) & (estimate("sig_x", "sig_y") >= LEAST_ESTIMATE)
    once = (F.col("cy") == F.col("main")) | (F.col("x") < F.col("y"))
    first = F.array_intersect("bands_x", "bands_y")[0] == xs["band"]
    across = xs.join(ys, (xs["band"] == ys["band"]) & (F.col("cx") != F.col("cy")) & once & near & first & may_link("x", "y"))
    more = stored(confirmed(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()), "links")
    repeats = ids.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    every = stored(links.unionByName(more).unionByName(repeats), "links")
    found = components(every)
    member = ids.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(found, F.col("rep") == F.col("v"), "left").select("doc_id", F.coalesce("c", "rep").alias("component"))
    return rows.select("doc_id", "n_shingles").join(member, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
