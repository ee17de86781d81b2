"""Token ids in raw shard files with a minimal perfect hash index over document keys.

Documents go to shards in ascending doc_id order.  A shard file is the raw ids, 16 bits each where the vocabulary
allows and 32 otherwise, and nothing else.  The index is cut by key hash into buckets of bounded size; each bucket
holds a minimal perfect hash over 128-bit keys (levels of bit maps, with the count of bits before every 512th: a key
settles on the first level where it is alone) and, in slot order, a 32-bit fingerprint of the key, shard, offset and
length.  A lookup hashes once, finds its slot from one stored count and at most eight words of bits, compares the
fingerprint, and reads that range of one file.

Rows are ranged by doc_id and then by hash of the text and place in the scan, so one id with a great many rows spreads
over tasks like any others.  Shard files are named by task attempt; only those that the committed record table names
count, so a lost executor or a repeated attempt leaves at most an unused file.  Paths may be any that pyarrow's file
systems know.

Defined cases: a null or empty text is the end id alone; a null doc_id sorts first and is a key like any other;
rows that repeat a doc_id are keyed by their number among equals (in the order in which they are written); an id that
does not fit the asked width is an error; an empty table gives no shards and no rows; extra columns are not read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import bytebpe
from .common import documents, new_folder, small_batches, stored

#: Ids and documents that a shard holds at most (a longer document has a shard of its own).
SHARD_IDS, SHARD_DOCS = 4_000_000, 100_000
#: Keys of an index bucket, on average.
BUCKET_KEYS = 50_000
#: Bytes read from a shard file at once, where neighbours are asked for.
READ_BYTES = 1 << 20
#: Bits of a level for each key that has not settled.
GAMMA = 2.0

RECORDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ordinal", T.LongType()), T.StructField("pid", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType())])


def _open(folder: str, name: str, mode: str):
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    if mode == "w":
        system.create_dir(base, recursive=True)
        return system.open_output_stream(f"{base}/{name}")
    return system.open_input_file(f"{base}/{name}")


def id_width(vocabulary: str | None = None, end_id: int = 0) -> int:
    """Bytes of an id: 2 where every id of the vocabulary fits, else 4."""
    known = bytebpe.encoder(vocabulary).tokenizer.get_vocab(with_added_tokens=True)
    return 2 if max([*known.values(), end_id]) < 1 << 16 else 4


def write_shards(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 0, width: int | None = None) -> DataFrame:
    """Writes doc_id, text as shards under folder; returns the stored record of each document. width: bytes of an id."""
    spark = docs.sparkSession
    small_batches(spark)
    least = id_width(vocabulary, end_id)
    if (width or least) < least:
        raise ValueError(f"ids of this vocabulary need {least} bytes")
    width = width or least
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "h", "place"]
    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    ordered = placed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    arrow, end = to_arrow_schema(RECORDS), int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pid, attempt = bytebpe.encoder(vocabulary).encode, TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        shard, at, count, previous, ordinal, out = -1, SHARD_IDS, 0, object(), 0, None
        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in RECORDS}
            payload: list[bytes] = []
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                ids = encode(text) + end
                if at + len(ids) // 4 > SHARD_IDS or count >= SHARD_DOCS:
                    if out:
                        out.write(b"".join(payload))
                        out.close()
                        payload.clear()
                    shard, at, count = shard + 1, 0, 0
                    name = f"ids-{pid:06d}-{shard:05d}-{attempt}.u{8 * width}"
                    out = _open(folder, name, "w")
                ordinal = ordinal + 1 if doc_id == previous else 0
                previous = doc_id
                payload.append(np.frombuffer(ids, dtype="<u4").astype(f"<u{width}").tobytes())
                for column, value in zip(rows.values(), (doc_id, ordinal, pid, shard, name, at, len(ids) // 4), strict=True):
                    column.append(value)
                at, count = at + len(ids) // 4, count + 1
            if out and payload:
                out.write(b"".join(payload))
            if rows["pid"]:
                yield pa.RecordBatch.from_pydict(rows, schema=arrow)
        if out:
            out.close()

    records = stored(ordered.mapInArrow(run, RECORDS), "records")
    # an id whose rows lie in several tasks is counted on from task to task; these are the ids at the tasks' edges
    key = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")
    edges = records.groupBy("pid").agg(F.min(key).alias("x"), F.max(key).alias("y"))
    edges = edges.select(F.explode(F.array("x.doc_id", "y.doc_id")).alias("e")).groupBy("e").agg(F.count("*").alias("n")).where("n > 1").select("e")
    per = records.join(edges, F.col("doc_id").eqNullSafe(F.col("e")), "left_semi").groupBy("doc_id", "pid").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("doc_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.sum("n").over(earlier)).where("before IS NOT NULL").select(F.col("doc_id").alias("e"), F.col("pid").alias("p"), "before")
    per = stored(per, "straddling")
    if per.isEmpty():
        return records
    counted = records.join(per, F.col("doc_id").eqNullSafe(F.col("e")) & (F.col("pid") == F.col("p")), "left")
    return stored(counted.withColumn("ordinal", F.col("ordinal") + F.coalesce("before", F.lit(0))).select(RECORDS.names), "records")


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys and a seed."""
    x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salted(keys: np.ndarray, others: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit value of a 128-bit key for each seed."""
    return mixed(keys ^ mixed(others, seed + 500), seed)


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys (two arrays of 64 bits): slots() is a permutation of 0 .. n - 1 over
    the keys it was built from. For other keys it gives any slot or -1; the stored fingerprint tells them apart.

    A level is its size, its bits in 64-bit words, and the count of bits before each eighth word, counted on over levels."""

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def build(cls, keys: np.ndarray, others: np.ndarray) -> "PerfectHash":
        levels, settled = [], 0
        while keys.size:
            m = -(-max(64, int(GAMMA * keys.size)) // 512) * 512
            place = (_salted(keys, others, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(place, minlength=m) == 1
            counts = alone.reshape(-1, 512).sum(axis=1)
            levels.append((m, np.packbits(alone, bitorder="little").view("<u8"), (settled + np.cumsum(counts) - counts).astype("<u4")))
            settled += int(counts.sum())
            keep = ~alone[place]
            keys, others = keys[keep], others[keep]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def slots(self, keys: np.ndarray, others: np.ndarray) -> np.ndarray:
        out, open_ = np.full(keys.size, -1, dtype=np.int64), np.arange(keys.size)
        for k, (m, words, before) in enumerate(self.levels):
            place = (_salted(keys[open_], others[open_], k) % np.uint64(m)).astype(np.int64)
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            here = (words[word] >> bit & np.uint64(1)).astype(bool)
            word, bit, first = word[here], bit[here], word[here] & ~7
            slot = before[first >> 3].astype(np.int64) + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            for j in range(7):
                slot += np.where(first + j < word, np.bitwise_count(words[np.minimum(first + j, word)]), 0)
            out[open_[here]] = slot
            open_ = open_[~here]
        return out

    def dump(self) -> bytes:
        head = json.dumps([m for m, _, _ in self.levels]).encode()
        return len(head).to_bytes(4, "little") + head + b"".join(words.tobytes() + before.tobytes() for _, words, before in self.levels)

    @classmethod
    def load(cls, data: bytes) -> "PerfectHash":
        """The arrays as they lie in data; nothing is counted anew."""
        n = int.from_bytes(data[:4], "little")
        at, levels = 4 + n, []
        for m in json.loads(data[4 : 4 + n]):
            levels.append((m, np.frombuffer(data, "<u8", m // 64, at), np.frombuffer(data, "<u4", m // 512, at + m // 8)))
            at += m // 8 + m // 128
        return cls(levels)


def _keys() -> list[Column]:
    """A document key's 128 bits."""
    parts = (F.col("doc_id"), F.col("doc_id").isNull(), F.col("ordinal"))
    return [F.xxhash64(*parts).alias("key"), F.xxhash64(F.lit(7), *parts).alias("other")]


def _bits(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return tuple(part[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("key", "other"))


def _prints(keys: np.ndarray, others: np.ndarray) -> np.ndarray:
    return (_salted(others, keys, 999) >> np.uint64(32)).astype("<u4")


INDEX = T.StructType([
    T.StructField("bucket", T.LongType()), T.StructField("hash", T.BinaryType()),
    *[T.StructField(c, T.BinaryType()) for c in ("prints", "shards", "offsets", "lengths")], T.StructField("files", T.ArrayType(T.StringType())),
])


def build_index(records: DataFrame, buckets: int) -> DataFrame:
    """One row for each bucket of keys: the perfect hash and the slots' fingerprints, shard files, offsets and lengths."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        keys = _bits(part)
        hashed = PerfectHash.build(*keys)
        order = np.argsort(hashed.slots(*keys))
        files, shard = np.unique(part["file"].to_numpy().astype(str), return_inverse=True)
        arrays = (_prints(*keys), shard.astype("<i4"), part["offset"].to_numpy().astype("<i8"), part["n_tokens"].to_numpy().astype("<i8"))
        return pd.DataFrame([[part["bucket"].iloc[0], hashed.dump(), *(a[order].tobytes() for a in arrays), files.tolist()]], columns=INDEX.names)

    keyed = records.select("*", *_keys()).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    return keyed.select("bucket", "key", "other", "file", "offset", "n_tokens").groupBy("bucket").applyInPandas(build, INDEX)


FOUND = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("ordinal", T.LongType()),
    T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType()),
])


def look_up(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """File, offset and length for each key (doc_id, ordinal); keys that are not in the index get no row."""

    def find(part: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if part.empty or rows.empty:
            return pd.DataFrame(columns=FOUND.names)
        row = rows.iloc[0]
        bits = _bits(part)
        prints, shards, offsets, lengths = (np.frombuffer(row[c], t) for c, t in (("prints", "<u4"), ("shards", "<i4"), ("offsets", "<i8"), ("lengths", "<i8")))
        slots = PerfectHash.load(row["hash"]).slots(*bits)
        good = (slots >= 0) & (prints[np.maximum(slots, 0)] == _prints(*bits))
        part, slots = part[good], slots[good]
        files = np.array(list(row["files"]), dtype=object)
        return pd.DataFrame({"doc_id": part["doc_id"], "ordinal": part["ordinal"], "file": files[shards[slots]], "offset": offsets[slots], "n_tokens": lengths[slots]})

    keyed = keys.select("doc_id", "ordinal", *_keys()).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    return keyed.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, FOUND)


READ = T.StructType([*FOUND.fields, T.StructField("ids", T.BinaryType())])


def _ranges(f, offsets: list[int], lengths: list[int], width: int) -> Iterator[np.ndarray]:
    """The ids of ascending ranges of an open file; neighbours are read at once, READ_BYTES or one range at most."""
    start, data = 0, b""
    for k, (at, n) in enumerate(zip(offsets, lengths, strict=True)):
        first, past = width * at, width * (at + n)
        if past > start + len(data) or first < start:
            stop, j = past, k + 1
            while j < len(offsets) and width * offsets[j] == stop and stop + width * lengths[j] - first <= READ_BYTES:
                stop, j = stop + width * lengths[j], j + 1
            f.seek(first)
            start, data = first, f.read(stop - first)
        yield np.frombuffer(data, f"<u{width}", n, first - start)


def read_ids(found: DataFrame, folder: str, width: int = 2, digest: bool = False) -> DataFrame:
    """The ids of looked-up keys as little-endian unsigned 32-bit integers, or with digest their crc32 instead.

    A file is opened once; only the asked ranges are read."""
    schema = T.StructType([*FOUND.fields, T.StructField("ids_crc32", T.LongType()) if digest else READ["ids"]])

    def read(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("offset")
        with _open(folder, part["file"].iloc[0], "r") as f:
            ids = (x.astype("<u4").tobytes() for x in _ranges(f, part["offset"].tolist(), part["n_tokens"].tolist(), width))
            return part.assign(**{schema.names[-1]: [zlib.crc32(x) for x in ids] if digest else list(ids)})[schema.names]

    return found.groupBy("file").applyInPandas(read, schema)


def shard_starts(records: DataFrame) -> DataFrame:
    """Ids before each shard, by sums of sums: over the tasks first (one row each, so one window holds them), then within each task."""
    shards = records.groupBy("pid", "shard", "file").agg(F.sum("n_tokens").alias("n"))
    before = (Window.unboundedPreceding, -1)
    tasks = shards.groupBy("pid").agg(F.sum("n").alias("n"))
    tasks = tasks.select("pid", F.sum("n").over(Window.orderBy("pid").rowsBetween(*before)).alias("task_start"))
    inner = F.sum("n").over(Window.partitionBy("pid").orderBy("shard").rowsBetween(*before))
    return shards.withColumn("inner", inner).join(tasks, "pid").select("file", (F.coalesce("task_start", F.lit(0)) + F.coalesce("inner", F.lit(0))).alias("shard_start"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes, writes shards and index, then looks up every key and reads its ids back from the files."""
    folder = new_folder(spark, "shards")
    records = write_shards(documents(spark, sf_dir), folder)
    buckets = max(1, -(-records.count() // BUCKET_KEYS))
    index = stored(build_index(records, buckets), "index")
    ids = read_ids(look_up(records.select("doc_id", "ordinal"), index, buckets), folder, id_width(), digest=True)
    start = (F.col("shard_start") + F.col("offset")).alias("start")
    return ids.join(shard_starts(records), "file").select("doc_id", start, "n_tokens", "ids_crc32")
