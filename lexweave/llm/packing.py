"""Packing of token sequences: shortest-pack-first over the length histogram.

Documents are encoded once, cut into full pieces and one rest, and only (length, rank within length) of the
rests matters from there on.  The histogram of lengths has at most ``size`` - 1 entries whatever the corpus;
the driver places lengths longest first into the packs with most room and notes each placement as a range of
ranks and a range of packs.  Pieces find their range by rank, so no row is gathered anywhere.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each for itself; an empty
table gives no rows; ties of rank follow partition and row order of the stored pieces; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytebpe
from .common import arrow_map, documents, stored

#: Ranks of one length stay below this, and keys of (length, rank) below 2 ** 63.
RANKS = 1 << 44


def pieces_schema(with_ids: bool) -> T.StructType:
    fields = [("doc_id", T.LongType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("pid", T.IntegerType()), ("seq", T.LongType())]
    return T.StructType([T.StructField(*f) for f in [*fields, *([("ids", T.BinaryType())] if with_ids else [])]])


def cut_documents(docs: DataFrame, size: int = 1024, vocabulary: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids (doc_id, text in; end id appended), with their rank within length and task."""
    end = int(end_id).to_bytes(4, "little")

    def make():
        encode, ranks, pid = bytebpe.encoder(vocabulary).encode, np.zeros(size + 1, dtype=np.int64).tolist(), TaskContext.get().partitionId()

        def batch(rows: dict) -> dict:
            out: dict[str, list] = {f.name: [] for f in pieces_schema(with_ids)}
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                ids = encode(text) + end
                for at in range(0, len(ids), 4 * size):
                    piece = ids[at : at + 4 * size]
                    n = len(piece) // 4
                    row = (doc_id, at // 4, n, zlib.crc32(piece), len(ids) // 4, pid, ranks[n], piece)
                    ranks[n] += 1
                    for column, value in zip(out.values(), row, strict=False):
                        column.append(value)
            return out

        return batch

    return arrow_map(docs.select("doc_id", "text"), make, pieces_schema(with_ids))


def place(histogram: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Shortest-pack-first. Placements (length, first rank, first pack, offset), each up to the next one of its length; number of packs.

    A group is a range of packs with the same pattern of lengths: [first pack, how many]. Groups are kept by room.
    """
    by_room: dict[int, list[list[int]]] = defaultdict(list)
    placements, packs = [], 0
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left, rank, room = histogram[length], 0, size
        while left:
            while room >= length and not by_room[room]:
                room -= 1
            if room < length:  # fits nowhere: open packs, each filled with this length before the next, the last with what is left over
                for many, each in ((left // (size // length), size // length), (1, left % (size // length))):
                    if many and each:
                        placements += [(length, rank + k * many, packs, k * length) for k in range(each)]
                        by_room[size - each * length].append([packs, many])
                        packs, rank = packs + many, rank + many * each
                left = 0
                continue
            group = by_room[room][-1]
            taken = min(left, group[1])
            placements.append((length, rank, group[0], size - room))
            by_room[room - length].append([group[0], taken])
            rank, left = rank + taken, left - taken
            if taken == group[1]:
                by_room[room].remove(group)
            else:
                group[:] = [group[0] + taken, group[1] - taken]
    return placements, packs


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to stored pieces. Full pieces are sequences of their own; the others are placed by length."""
    counts = stored(pieces.groupBy("length", "pid").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    full = histogram.pop(size, 0)
    placements, _ = place(histogram, size)
    placements = [(size, 0, -full, 0), *placements]
    placements.sort()
    lengths, ranks, firsts, offsets = (np.array(x, dtype=np.int64) for x in zip(*placements, strict=True))
    keys = lengths * RANKS + ranks
    earlier = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "pid", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    before = before.hint("merge")  # grows with the number of tasks, so it is shuffled and not sent to all
    ranked = pieces.join(before, ["length", "pid"]).withColumn("rank", F.col("before") + F.col("seq")).drop("before", "seq", "pid")
    names = [c for c in ranked.columns if c != "rank"]
    schema = T.StructType([*[ranked.schema[c] for c in names], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def make():
        def batch(rows: dict) -> dict:
            length, rank = np.array(rows["length"], dtype=np.int64), np.array(rows["rank"], dtype=np.int64)
            at = np.searchsorted(keys, length * RANKS + rank, side="right") - 1
            return {c: rows[c] for c in names} | {"sequence_id": full + firsts[at] + rank - ranks[at], "offset": offsets[at]}

        return batch

    return arrow_map(ranked, make, schema)


def sequences(packed: DataFrame, size: int = 1024) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, ids, n_tokens. Each holds at most `size` ids."""
    items = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(items, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_tokens"))


def pack_documents(docs: DataFrame, size: int = 1024, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    return pack(stored(cut_documents(docs, size, vocabulary, with_ids=with_ids), "pieces"), size)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
