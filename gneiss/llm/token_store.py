"""Token-ID output: whole documents as token ids in range-coded segments, in ascending order of their ids."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegralType

from gneiss.llm import rans
from gneiss.llm.session import new_path, only_cache, small_batches, text_or_empty, written

END_ID = 0
#: Tokens after which a segment ends with the document it is in.
SEGMENT_TOKENS = 1 << 20
#: Pieces of text, and their characters, in each of the two generations that a worker keeps; pieces whose ids it keeps
#: until it starts anew.
CACHE_PIECES, CACHE_CHARS, KNOWN_PIECES = 750_000, 16_000_000, 2_500_000
SEGMENTS_IN_BATCH = 8
#: Characters of texts that are encoded at once.
ENCODE_CHARS = 1_000_000
#: Signs that are cut off behind a letter: never part of its token. An apostrophe can be.
SIGNS = ".,!?;:*#$%&|()[]\"-"
#: New cores that are encoded in one text.
TOGETHER = 512
#: A space between two characters that aren't white space: no pre-token reaches over its left side.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


class _Pieces(dict):
    """Piece of text to its number; a new one is listed, with whether a space is before it, to be encoded.

    Two generations: after turn(), pieces that come again move over from the old one, and the next turn drops the others.
    """

    def __init__(self, encoder: Encoder, spaced: bool) -> None:
        self.encoder, self.spaced, self.old = encoder, spaced, {}

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            own = self.encoder
            n = own.known
            own.known += 1
            own.listed.append((piece, self.spaced))
        self[piece] = n
        return n

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()


class Encoder:
    """Byte-level BPE ids of whole texts, through the ids of their pieces between single spaces and line ends.

    The pre-tokenizer's pattern takes a space along with the word after it and never joins it to the word before, and a
    lone line end is a token by itself. So a text's ids are those of its pieces, with the space before them unless they
    begin a line. A piece that is empty or begins or ends with white space, as next to two spaces, could be read
    otherwise alone: a text that has one is cut only at spaces between characters that aren't white space.

    A piece that ends in signs behind a letter is the piece before them and the signs, which are always another token.
    New pieces are encoded many at once in one text; their ids begin where a token begins with a space, or after a line end.
    """

    def __init__(self, path: str, special: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[k for token, k in vocabulary.items() if token.startswith("\u0120")]] = True
        self.line_end = self._encoded(["\n"])[0][0]
        self._clear()

    def _clear(self) -> None:
        self.known, self.chars = 0, 0
        self.listed: list[tuple[str, bool]] = []
        self.heads, self.pieces = _Pieces(self, False), _Pieces(self, True)
        self.odd, self.core, self.tail = np.zeros(0, bool), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.begin, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.nothing, self.end_number = self.heads[""], self.heads["\n"]

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Finds the ids of the pieces listed since, and of the parts that they are made of."""
        first, k = len(self.odd), 0
        if first == self.known:
            return
        space = str.isspace
        odd, core, tail = [], [], []
        plain: dict[bool, list[int]] = {True: [], False: []}
        alone: list[int] = []
        listed, nothing = self.listed, self.nothing
        while k < len(listed):
            piece, spaced = listed[k]
            self.chars += len(piece)
            if piece.isalpha():  # most pieces: no white space, no signs
                odd.append(False)
                core.append(first + k)
                tail.append(nothing)
                plain[spaced].append(k)
                k += 1
                continue
            odd.append(not piece or space(piece[-1]) or space(piece[0]))
            stem = piece.rstrip(SIGNS)
            if len(stem) == len(piece) or not stem or not stem[-1].isalpha():
                core.append(first + k)
                tail.append(nothing)
                (alone if not piece or " " in piece or "\n" in piece else plain[spaced]).append(k)
            else:
                core.append((self.pieces if spaced else self.heads)[stem])
                tail.append(self.heads[piece[len(stem) :]])
            k += 1
        odd = np.array(odd, bool)
        if not first:
            odd[self.end_number] = False  # a line end is one token wherever it is cut off
        begin, length = np.zeros(k, np.int32), np.zeros(k, np.int32)
        parts, size = [self.ids], len(self.ids)
        for spaced, own in plain.items():
            groups = [own[j : j + TOGETHER] for j in range(0, len(own), TOGETHER)]
            for group, ids in zip(groups, self._encoded([" " + " ".join([listed[j][0] for j in g]) if spaced else "\n".join([listed[j][0] for j in g]) for g in groups])):
                if spaced:
                    start = np.flatnonzero(self.opens[ids])
                    stop = np.append(start[1:], len(ids))
                else:
                    cuts = np.flatnonzero(ids == self.line_end)
                    start, stop = np.concatenate(([0], cuts + 1)), np.append(cuts, len(ids))
                if len(start) != len(group):
                    alone += group
                    continue
                begin[group], length[group] = size + start, stop - start
                parts.append(ids)
                size += len(ids)
        for j, ids in zip(alone, self._encoded([" " + listed[j][0] if listed[j][1] else listed[j][0] for j in alone])):
            begin[j], length[j] = size, len(ids)
            parts.append(ids)
            size += len(ids)
        self.listed.clear()
        self.ids = np.concatenate(parts)
        for name, new in (("odd", odd), ("core", np.array(core, np.int32)), ("tail", np.array(tail, np.int32)), ("begin", begin), ("length", length)):
            setattr(self, name, np.concatenate((getattr(self, name), new)))

    def _numbers(self, text: str) -> list[int]:
        out: list[int] = []
        get, end = self.pieces.__getitem__, self.end_number
        for line in text.split("\n"):
            own = line.split(" ")
            out.append(self.heads[own[0]])
            if len(own) > 1:
                out += map(get, own[1:])
            out.append(end)
        out.pop()
        return out

    def _careful(self, text: str) -> list[int]:
        head, *rest = _BETWEEN.split(text)
        return [self.heads[head], *map(self.pieces.__getitem__, rest)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each text's followed by END_ID, and the number of each text's."""
        if self.known > KNOWN_PIECES:
            self._clear()
        elif len(self.pieces) + len(self.heads) > CACHE_PIECES or self.chars > CACHE_CHARS:
            self.pieces.turn()
            self.heads.turn()
            self.chars = 0
        numbers = [self._numbers(t) if t else [] for t in texts]
        self._learn()
        flat, first = _flat(numbers)
        bad = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.odd[flat])))
        again = np.flatnonzero(bad[first[1:]] > bad[first[:-1]])
        if len(again):
            for k in again:
                numbers[k] = self._careful(texts[k])
            self._learn()
            flat, first = _flat(numbers)
        parts = np.empty((len(flat), 2), np.int64)
        parts[:, 0], parts[:, 1] = self.core[flat], self.tail[flat]
        parts = parts.ravel()
        length = self.length[parts]
        end = np.concatenate((np.zeros(1, np.int64), np.cumsum(length)))
        ids = self.ids[np.arange(end[-1]) + np.repeat(self.begin[parts] - end[:-1], length)] if len(flat) else np.zeros(0, np.uint32)
        stop = end[2 * first]
        return np.insert(ids, stop[1:], np.uint32(END_ID)), np.diff(stop) + 1


def _flat(numbers: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, numbers), np.int64, len(numbers))
    first = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
    return np.fromiter(chain.from_iterable(numbers), np.int64, int(first[-1])), first


def encoder(path: str, special: bool) -> Encoder:
    """One for each worker, which keeps its pieces over tasks."""
    return only_cache(("encoder", path, special), lambda: Encoder(path, special))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, special: bool = True, segment: int = SEGMENT_TOKENS) -> None:
    """Writes docs' ids to the folder path: Parquet files of rows (part, number, data), data a segment of rans.py; doc_ids that aren't integers are in a further column, names, beside their segment.

    The rows of docs (doc_id, text) are in ascending order of doc_id, nulls first, then of their texts' hashes:
    parts hold ranges of them, and a part's segments follow each other by number. A range of equal doc_ids is cut
    by the hashes. Null texts are empty and give END_ID alone; repeated rows are written as often as they are there.
    special: whether special tokens' strings in a text become those tokens, as is the library's default.
    """
    small_batches(docs.sparkSession)
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    given = docs.select(F.col("doc_id"), text_or_empty().alias("text"))
    tie = F.xxhash64("text")
    ordered = given.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)

    def segments(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, before = encoder(tokenizer, special), 0, 0
        keys: list[Any] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        waiting: list[str] = []
        part, size, chars = None, 0, 0

        def flush() -> None:
            nonlocal size, chars
            got, n = own.encode(waiting)
            counts.append(n)
            ids.append(got)
            size += len(got)
            waiting.clear()
            chars = 0

        def closed() -> pa.RecordBatch:
            data = rans.encode(keys if whole else list(range(len(keys))), np.concatenate(counts), np.concatenate(ids), before)
            row = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(row if whole else [*row, pa.array([keys], pa.list_(pa.string()))], ["part", "number", "data", *(() if whole else ("names",))])

        for batch in found:
            part = batch.column(2)[0].as_py() if batch.num_rows and part is None else part
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(key)
                waiting.append(text)
                chars += len(text)
                if chars >= ENCODE_CHARS:
                    flush()
                    if size >= segment:
                        yield closed()
                        number, before, size = number + 1, before + size, 0
                        keys, counts, ids = [], [], []
        if waiting:
            flush()
        if keys:
            yield closed()

    sent = ordered.select(F.col("doc_id").cast("long" if whole else "string").alias("doc_id"), "text", F.spark_partition_id().alias("part"))
    sent.mapInArrow(segments, "part int, number int, data binary" + ("" if whole else ", names array<string>")).write.parquet(path)


def _segments(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(part, data, names) of the files, names null where doc_ids are integers; and the type of the doc_ids."""
    found = spark.read.parquet(path)
    named = "names" in found.columns
    names = F.col("names") if named else F.lit(None).cast("array<string>").alias("names")
    return found.select("part", "data", names), "string" if named else "long"


def _ids(doc_ids: list, names: list | None) -> pa.Array:
    return pa.array(doc_ids, pa.int64()) if names is None else pa.array(names, pa.string())


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every document in the files of write_tokens; ids as an array of longs, doc_id as a long or, if it was none, a string."""
    given, kind = _segments(spark, path)

    def rows(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for data, names in zip(batch.column(1), batch.column(2).to_pylist()):
                doc_ids, counts, ids, _ = rans.decode(data.as_py())
                at = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
                yield pa.RecordBatch.from_arrays([_ids(doc_ids, names), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int64)))], ["doc_id", "ids"])

    return given.mapInArrow(rows, f"doc_id {kind}, ids array<long>")


def summarise_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files of write_tokens.

    start: the ids of all documents before it. A part's segments know the ids before them in the part; those of the
    parts before are summed over one row for each part. doc_id is a long or, if it was none, a string.
    """
    given, kind = _segments(spark, path)

    def rows(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for part, data, names in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                doc_ids, counts, ids, before = rans.decode(data.as_py())
                at = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(doc_ids), pa.int32()), _ids(doc_ids, names), pa.array(at[:-1] + before), pa.array(counts), pa.array(crcs, pa.int64())],
                    ["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(key, "10000")
    spark.conf.set(key, str(SEGMENTS_IN_BATCH))
    try:
        found = written(given.mapInArrow(rows, f"part int, doc_id {kind}, start long, n_tokens long, ids_crc32 long"), "tokens-read")
    finally:
        spark.conf.set(key, kept)
    sums = found.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = written(sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")), "tokens-parts")
    return found.join(before, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def tokenize(docs: DataFrame, tokenizer: str, special: bool = True) -> DataFrame:
    """Writes docs' tokens to a new folder in the shared one and returns what the files hold of each document, doc_id in its own type. Ids of any orderable type, and null, are allowed."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, special)
    found = summarise_tokens(docs.sparkSession, path)
    kind = docs.schema["doc_id"].dataType
    return found if isinstance(kind, IntegralType) else found.withColumn("doc_id", F.col("doc_id").cast(kind))
