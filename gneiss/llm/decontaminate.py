"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A document that holds the share c of an item's q distinct shingles lacks at most (1 - c) q of them, so of any (1 - c) q + 1 it
holds one. The search keeps of each item the MinHash sketch of so many least shingle hashes, as its size class has it, those that
the fewest items share first, and looks a whole document's shingles up among the sketches of all items: no document that holds an
item is missed, wherever in it the item's shingles are. Only documents and items that meet in a sketch, and of which the document
is large enough for the item, are candidates; these are verified on all their shingles. So a phrase that many items and many
documents share is in no sketch, and makes no pairs, unless an item has hardly anything else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gneiss.llm.filters import hash_filter, held, maybe_in
from gneiss.llm.session import free_name, small_batches, text_or_empty, written
from gneiss.llm.words import Words, shingles, slices, words

SHINGLE = 5
#: Of a test item's distinct shingles, the share that a document holds at least.
CONTAINMENT = 0.8
#: Bits for each item's shingle in the bitmaps, up to their bound: of 8,192 other shingles one passes.
LOOKUP_BITS = 1 << 13
_ITEM_COLUMNS = {"gram": "string", "sketch": "long", "shingles": "long", "wanted": "long", "size": "long", "h": "long"}


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def distinct_shingles(found: list[bytes], size: int) -> set:
    return set(zip(*(found[k:] for k in range(size)))) if len(found) >= size else set()


def size_class(shingles: int) -> int:
    """The smallest power of two that holds so many."""
    return 1 << (shingles - 1).bit_length()


def sketch_size(shingles: int, containment: float) -> int:
    """Of an item of so many distinct shingles, the number of least hashes that are searched for: one more than its size class may lack."""
    return min(shingles, int((1 - containment) * size_class(shingles) + 1e-9) + 1)


def gram(found: Words, at: int, size: int) -> str:
    """The size words from word at on, A-Z lower-cased, joined by spaces."""
    own = (found.raw[a:b].tobytes() for a, b in zip(found.starts[at : at + size].tolist(), found.ends[at : at + size].tolist()))
    return b" ".join(own).lower().decode("utf-8", "surrogatepass")


def item_shingles(items: DataFrame, key: str, text: str, containment: float) -> DataFrame:
    """(item_id, item_text, gram, least, shingles, wanted, size, h): each distinct shingle of each distinct item, h its hash, least whether it is in
    the item's sketch, shingles the number of all, wanted how many of them a document has to hold. A sketch has the shingles of the fewest items, and of these the least hashes.

    An item of fewer than SHINGLE words is one shingle of all its words; one without words, or of null text, is left out.
    item_id may be of any type and null; item_text is a hash of the text, since items may share an id.
    """
    given = items.select(F.col(f"`{key}`").alias("item_id"), F.col(f"`{text}`").alias("text")).where("text is not null").distinct()
    given = given.select("item_id", F.xxhash64("text").alias("item_text"), "text")
    schema = given.select("item_id", "item_text").schema
    for name, kind in _ITEM_COLUMNS.items():
        schema = schema.add(name, kind)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = words(batch.column(2))
            plain = found.hashes()
            by_size = {n: shingles(found, plain, n) for n in range(1, SHINGLE + 1)}
            for k in range(batch.num_rows):
                n = int(found.first[k + 1] - found.first[k])
                if not n:
                    continue
                size = min(SHINGLE, n)
                runs, first = by_size[size]
                h, at = np.unique(runs[first[k] : first[k + 1]], return_index=True)
                grams = pa.array([gram(found, int(found.first[k] + a), size) for a in at], pa.string())
                whole = lambda v, kind: pa.array(np.full(len(h), v), kind)
                ids = batch.slice(k, 1).select([0, 1])
                same = [c.take(pa.array(np.zeros(len(h), np.int64))) for c in ids.columns]
                wanted = int(np.ceil(containment * len(h) - 1e-9))
                yield pa.RecordBatch.from_arrays([*same, grams, whole(sketch_size(len(h), containment), pa.int64()), whole(len(h), pa.int64()), whole(wanted, pa.int64()), whole(size, pa.int64()), pa.array(h.view(np.int64))], schema.names)

    each = written(given.mapInArrow(rows, schema), "leak-shingles")
    shared = each.groupBy("gram").agg(F.count("*").alias("items"))
    place = F.row_number().over(Window.partitionBy("item_id", "item_text").orderBy("items", "h", "gram"))  # an item's own shingles
    return each.join(shared, "gram").withColumn("least", place <= F.col("sketch")).drop("sketch", "items")


def met(column: pa.Array, sizes: list[int], sketches: np.ndarray, every: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
    """(place, words, shingles) of the texts with a shingle among the sketches: those of their distinct shingles that may be among every item's."""
    for lo, hi in slices(column):
        found = words(column.slice(lo, hi - lo))
        plain = found.hashes()
        asked: dict[int, set[str]] = {}
        for size in sizes:
            runs, first = shingles(found, plain, size)
            hits = np.concatenate((np.zeros(1, np.int64), np.cumsum(held(sketches, runs))))
            for k in np.flatnonzero(hits[first[1:]] > hits[first[:-1]]):
                own = runs[first[k] : first[k + 1]]
                for at in np.flatnonzero(held(every, own)):
                    asked.setdefault(int(k), set()).add(gram(found, int(found.first[k] + at), size))
        for k in sorted(asked):
            yield lo + k, int(found.first[k + 1] - found.first[k]), sorted(asked[k])


def _text_keys() -> tuple[Column, Column]:
    """128 bits of a text: documents of equal texts hold the same items."""
    text = text_or_empty()
    return F.xxhash64(text), F.xxhash64(text, F.lit("second"))


def candidates(found: DataFrame, known: DataFrame) -> DataFrame:
    """(k1, k2, item_id, item_text) of the texts (k1, k2, words, grams) and items (item_shingles) that meet in the item's sketch and by their sizes can be one in the other."""
    sketched = known.where("least").select("gram", "item_id", "item_text", "wanted")
    pairs = found.select("k1", "k2", "words", F.explode("grams").alias("gram")).join(sketched, "gram").where("words >= wanted")
    return pairs.select("k1", "k2", "item_id", "item_text").distinct()


def text_leaks(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(k1, k2, item_id, shared, shingles), written: the items that each distinct text of docs (text) holds; k1 and k2 as in _text_keys.

    shared of the item's distinct shingles are in the text, anywhere in it. One pass over the texts; only what meets an
    item's sketch leaves it, as shingles. The filters that are sent to all tasks are bitmaps of bounded size.
    """
    small_batches(docs.sparkSession)
    known = written(item_shingles(items, key, item_text, containment), "leak-items")
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())  # SHINGLE at most
    share = docs.sparkSession.sparkContext.broadcast
    sketches, every = share(hash_filter(known.where("least").select("h"), LOOKUP_BITS)), share(hash_filter(known.select("h"), LOOKUP_BITS))

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            got = list(met(batch.column(2), sizes, sketches.value, every.value))
            places = pa.array([k for k, _, _ in got], pa.int64())
            columns = [batch.column(0).take(places), batch.column(1).take(places), pa.array([n for _, n, _ in got], pa.int64()), pa.array([g for _, _, g in got], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "words", "grams"])

    k1, k2 = _text_keys()
    found = docs.select(k1.alias("k1"), k2.alias("k2"), text_or_empty().alias("text")).mapInArrow(rows, "k1 long, k2 long, words long, grams array<string>")
    found = written(found.groupBy("k1", "k2").agg(F.first("words").alias("words"), F.first("grams").alias("grams")), "leak-texts")
    whole = known.groupBy("item_id", "item_text", "shingles", "wanted").agg(F.collect_list("gram").alias("own"))  # an item's own shingles
    both = candidates(found, known).alias("c").join(whole.alias("w"), F.col("c.item_id").eqNullSafe(F.col("w.item_id")) & (F.col("c.item_text") == F.col("w.item_text")))
    both = both.select("k1", "k2", "c.item_id", "shingles", "wanted", "own").join(found.select("k1", "k2", "grams"), ["k1", "k2"])
    counted = both.select("k1", "k2", "item_id", F.size(F.array_intersect("grams", "own")).cast("long").alias("shared"), "shingles", "wanted")
    return written(counted.where("shared >= wanted").select("k1", "k2", "item_id", "shared", "shingles"), "leaks")


def leaked_pairs(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, shared, shingles, containment): one row for each row of docs and item that it holds.

    Shingles are five words of ASCII-lower-cased text; a document holds an item if it has at least the share
    containment of the item's distinct shingles. Ids may be of any type and null. Null and empty texts hold nothing, items without
    words are held by nothing; equal items count once, repeated documents each.
    """
    leaks = text_leaks(docs.select("text"), items, containment)
    k1, k2 = _text_keys()
    keyed = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"))
    return keyed.join(leaks, ["k1", "k2"]).select("doc_id", "item_id", "shared", "shingles", (F.col("shared") / F.col("shingles")).alias("containment"))


def drop_leaked(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """docs without the rows whose text holds a test item (leaked_pairs); all its columns stay. Only texts that may hold one are shuffled, if any are."""
    leaks = text_leaks(docs.select("text"), items, containment).select("k1", "k2").distinct()
    k1, k2 = _text_keys()
    one, two = free_name(docs, "leak_k1"), free_name(docs, "leak_k2")
    keyed = docs.withColumn(one, k1).withColumn(two, k2)
    maybe = maybe_in(leaks.select(F.col("k1").alias("h")), F.col(one))
    leaks = leaks.toDF(one, two)
    kept = keyed.where(~maybe).unionByName(keyed.where(maybe).join(leaks, [one, two], "left_anti"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
