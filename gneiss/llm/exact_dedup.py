"""Exact duplicates by content-defined chunk recipes: what is compared is each text's list of chunk identifiers, not the text."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from gneiss.llm.filters import hash_filter, held
from gneiss.llm.session import only_cache, small_batches, text_or_empty, written
from gneiss.llm.words import slices, utf8

#: Bytes of a chunk: at least, at most (but for a text's last one, which may be shorter), and 2 to this power on average beyond the least.
LEAST, MOST, POWER = 2048, 16384, 12
#: A chunk ends where a hash of the 16 bytes before says so, wherever these bytes are.
WINDOW = 16
_FACTORS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text that are cut at once, and bytes of chunks that a task keeps to compare later ones with.
BLOCK, KEPT = 1 << 20, 1 << 26
#: Seeds that are tried; a second one is only needed where two chunks of one 128-bit digest differ.
MAX_SEEDS = 32


def ends(raw: np.ndarray) -> list[int]:
    """Where a chunk may end, rising: behind each window whose hash has POWER leading zeros."""
    if len(raw) < WINDOW:
        return []
    eights = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), 0, (1,))
    hashes = eights[:-8] * _FACTORS[0] + (eights[8:] ^ (eights[8:] >> np.uint64(29))) * _FACTORS[1]
    return (np.flatnonzero(hashes >> np.uint64(64 - POWER) == 0) + WINDOW).tolist()


def bounds(found: list[int], start: int, end: int) -> Iterator[tuple[int, int]]:
    """The chunks of the text from start to end. found: ends(); those that LEAST reaches look at no byte before start."""
    while start < end:
        k = bisect_left(found, start + LEAST)
        stop = min(end, start + MOST, found[k] if k < len(found) else end)
        yield start, stop
        start = stop


def chunks(column: pa.Array) -> Iterator[list[bytes]]:
    """Of each text (UTF-8, null is empty), its chunks in order; equal texts have equal chunks, an empty one has none."""
    for lo, hi in slices(column, BLOCK):
        raw, at = utf8(column.slice(lo, hi - lo))
        found, data = ends(raw), raw.tobytes()
        for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield [data[a:b] for a, b in bounds(found, start, end)]


def digest(chunk: bytes, seed: int, bits: int = 128) -> tuple[int, int]:
    """A chunk's claimed identifier, as two signed 64-bit numbers: so many bits of its XXH3."""
    h = xxhash.xxh3_128_intdigest(chunk, seed) & ((1 << bits) - 1)
    return tuple(x - (1 << 64) if x >> 63 else x for x in (h & ((1 << 64) - 1), h >> 64))


def recipes(docs: DataFrame, seed: int, bits: int = 128) -> DataFrame:
    """docs with heads and tails in place of text: the identifiers of its chunks in order. One pass, without a shuffle."""
    carried = [c for c in docs.columns if c != "text"]
    schema = StructType([docs.schema[c] for c in carried]).add("heads", ArrayType(LongType(), False)).add("tails", ArrayType(LongType(), False))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache(None)
        for batch in found:
            ids = [[digest(c, seed, bits) for c in own] for own in chunks(batch.column(len(carried)))]
            halves = [pa.array([[x[half] for x in own] for own in ids], pa.list_(pa.int64())) for half in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *halves], [*carried, "heads", "tails"])

    return docs.select(*carried, "text").mapInArrow(batches, schema)


def clashing(docs: DataFrame, repeated: DataFrame, seed: int, bits: int = 128) -> DataFrame:
    """(head, tail) of identifiers that stand for two different chunks. repeated: (head, tail) of those that occur more than once.

    A chunk whose identifier occurs once is like no other, so its bytes stay where they are. Of the others, each task
    compares what it has at hand and hands on one copy; copies of an identifier are then compared byte by byte.
    The bitmap of identifiers has a bound of its own; beyond it more chunks are compared than need be, none fewer.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(hash_filter(repeated.select(F.col("head").alias("h"))))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache(None)
        seen: dict[tuple[int, int], bytes] = {}
        size = 0
        for batch in found:
            out: list[tuple[tuple[int, int], bytes]] = []
            for own in chunks(batch.column(0)):
                ids = [digest(c, seed, bits) for c in own]
                wanted = held(bitmap.value, np.array([i[0] for i in ids], np.int64)) if ids else ()
                for i, chunk, asked in zip(ids, own, wanted, strict=True):
                    if asked and seen.get(i) != chunk:
                        out.append((i, chunk))
                        if size > KEPT:
                            seen, size = {}, 0
                        if i not in seen:
                            seen[i] = chunk
                            size += len(chunk)
            yield pa.RecordBatch.from_arrays([pa.array([i[0] for i, _ in out], pa.int64()), pa.array([i[1] for i, _ in out], pa.int64()), pa.array([c for _, c in out], pa.binary())], ["head", "tail", "chunk"])

    sent = docs.select("text").mapInArrow(batches, "head long, tail long, chunk binary")
    return sent.distinct().groupBy("head", "tail").agg(F.count("*").alias("n")).where("n > 1").select("head", "tail")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 128) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256), one row per row of docs; texts are equal where their bytes are, null counts as empty.

    Every text is cut into chunks where its content says so, and becomes a recipe: the ordered list of its chunks'
    identifiers. An identifier is a seeded digest that is verified: each one that occurs more than once is held against
    the bytes of all chunks that claim it, and if two differ all is done again with another seed. So recipes are equal
    exactly where texts are, and only they are shuffled to be compared: 16 bytes for some 6,000.

    keep_id is the largest key of the group, null only where all its keys are; the one row that stays (kept) has it,
    and of rows that repeat it any one. group_size counts rows. An empty text has no chunks and equals other empty
    ones. An empty table gives no rows; other columns, of whatever name, are left out. key may have any orderable type.
    """
    small_batches(docs.sparkSession)
    given = docs.select(F.col(f"`{key}`").alias("key"), text_or_empty(f"`{text}`").alias("text")).withColumn("sha", F.sha2("text", 256)).withColumn("place", F.monotonically_increasing_id())
    for seed in range(MAX_SEEDS):
        found = written(recipes(given, seed, bits), "recipes")
        every = found.select(F.explode(F.arrays_zip("heads", "tails")).alias("i")).select(F.col("i.heads").alias("head"), F.col("i.tails").alias("tail"))
        repeated = written(every.groupBy("head", "tail").agg(F.count("*").alias("n")).where("n > 1").select("head", "tail"), "repeated-chunks")
        if clashing(given, repeated, seed, bits).isEmpty():
            break
    else:
        raise RuntimeError(f"{MAX_SEEDS} seeds gave different chunks one identifier")
    # Written, so that the join below reads it by an exchange of its own and a group's many rows can be split.
    groups = written(found.groupBy("heads", "tails").agg(F.count("*").alias("n"), F.max(F.struct("key", "place")).alias("top")).where("n > 1"), "equal-texts")
    own = found.join(groups, ["heads", "tails"], "left")
    return own.select(
        F.col("key").alias(key),
        F.when(F.col("n").isNull(), F.col("key")).otherwise(F.col("top.key")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("place") == F.col("top.place"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
