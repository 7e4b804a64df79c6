"""Vector code compression: product codebooks by Lloyd's rounds, with Yinyang's group bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gneiss.llm.session import written
from gneiss.llm.vectors import integer_vectors, matrix

#: Entries of a codebook for each of its groups.
PER_GROUP = 8
#: What bounds are slackened by, over any rounding: they only say what needn't be looked at; what is looked at is compared in integers.
SLACK = 1e-6


def grouped(book: np.ndarray, groups: int) -> np.ndarray:
    """The group of each entry: a few Lloyd rounds over the entries themselves, from far-apart ones. The same for the same book."""
    points = book.astype(np.float64)
    seeds = [0]
    while len(seeds) < min(groups, len(points)):
        seeds.append(int(((points[:, None] - points[seeds]) ** 2).sum(axis=2).min(axis=1).argmax()))
    centres = points[seeds]
    for _ in range(5):
        own = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([points[own == g].mean(axis=0) if (own == g).any() else centres[g] for g in range(len(centres))])
    return np.unique(own, return_inverse=True)[1]


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries, in int64."""
    return ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


def under(distances: np.ndarray) -> np.ndarray:
    """Roots of squared distances as float32 that aren't above them."""
    return np.nextafter(np.sqrt(distances.astype(np.float64)).astype(np.float32), np.float32(-1))


class Part:
    """One part position's codebook of a round: entries, their groups, and how far each group's entries moved at most since the round before."""

    def __init__(self, entries: np.ndarray, group: np.ndarray, before: np.ndarray | None):
        self.entries, self.group = entries, group
        self.members = [np.flatnonzero(group == g) for g in range(group.max() + 1)]
        moved = np.zeros(len(entries)) if before is None else np.sqrt(((entries - before) ** 2).sum(axis=1).astype(np.float64))
        self.drift = np.array([moved[m].max() for m in self.members]) * (1 + SLACK) + SLACK

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(nearest entry, exact squared distance, each group's lower bound, groups scanned) of rows without bounds."""
        return self._scan(x, np.zeros(len(x), np.int64), np.full((len(x), len(self.members)), -1.0, np.float32))

    def again(self, x: np.ndarray, code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same of rows with the nearest entry and the bounds of the round before."""
        return self._scan(x, code, bounds * np.float32(1 - SLACK) - self.drift.astype(np.float32))

    def _scan(self, x: np.ndarray, code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        own = ((x - self.entries[code]) ** 2).sum(axis=1)
        reach = np.sqrt(own.astype(np.float64)) * (1 + SLACK) + SLACK
        failed = bounds <= reach[:, None]  # an entry at the same distance may have the lower index: such a group is looked at
        best, at = own.copy(), code.copy()
        distances = []
        for g, members in enumerate(self.members):
            rows = np.flatnonzero(failed[:, g])
            found = squared(x[rows], self.entries[members])
            distances.append((rows, found))
            if len(rows):
                k = found.argmin(axis=1)  # the first, so the lowest index of the group
                d, i = found[np.arange(len(rows)), k], members[k]
                nearer = (d < best[rows]) | (d == best[rows]) & (i < at[rows])
                best[rows[nearer]], at[rows[nearer]] = d[nearer], i[nearer]
        out = bounds.copy()
        left = np.flatnonzero((at != code) & ~failed[np.arange(len(x)), self.group[code]])
        out[left, self.group[code[left]]] = np.minimum(out[left, self.group[code[left]]], under(own[left]))
        for g, (members, (rows, found)) in enumerate(zip(self.members, distances, strict=True)):
            others = np.where(members[None] == at[rows][:, None], np.iinfo(np.int64).max, found).min(axis=1, initial=np.iinfo(np.int64).max)
            out[rows, g] = np.where(others == np.iinfo(np.int64).max, np.float32(np.inf), under(others))
        return at, best, out, int(failed.sum())


def assigned(rows: DataFrame, books: np.ndarray, groups: list[np.ndarray], before: np.ndarray | None) -> DataFrame:
    """rows (key, label, x, and code and bounds where before, the round before's codebooks, is given) with code, error, bounds and scanned of these codebooks."""
    n, _, width = books.shape
    parts = [Part(books[p], groups[p], None if before is None else before[p]) for p in range(n)]
    size = [len(p.members) for p in parts]
    edges = np.concatenate(([0], np.cumsum(size)))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            x = matrix(batch.column(2), n * width)
            code, bounds = np.zeros((len(x), n), np.uint8), np.zeros((len(x), edges[-1]), np.float32)
            error, scanned = np.zeros(len(x), np.int64), 0
            if before is not None:
                code[:] = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, n)
                bounds[:] = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float32).reshape(-1, edges[-1])
            for p, part in enumerate(parts):
                own, at = x[:, p * width : (p + 1) * width], slice(edges[p], edges[p + 1])
                code[:, p], d, bounds[:, at], looked = part.first(own) if before is None else part.again(own, code[:, p].astype(np.int64), bounds[:, at])
                error += d
                scanned += looked
            packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (code, bounds)]
            share = np.zeros(len(x), np.int64)
            share[:1] = scanned
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *packed, pa.array(error), pa.array(share)], ["key", "label", "x", "code", "bounds", "error", "scanned"])

    schema = rows.select("key", "label", "x").schema.add("code", "binary").add("bounds", "binary").add("error", "long").add("scanned", "long")
    return rows.select("key", "label", "x", *(() if before is None else ("code", "bounds"))).mapInArrow(batches, schema)


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks with each entry replaced by the componentwise floor of its parts' mean; entries without parts stay. Each task sends a row for each entry it has met."""
    n, entries, width = books.shape

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(n * entries, np.int64), np.zeros((n * entries, width), np.int64)
        for batch in found:
            x = matrix(batch.column(0), n * width).reshape(-1, width)
            slot = (np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, n) + np.arange(n) * entries).ravel()
            order = np.argsort(slot, kind="stable")
            met, at = np.unique(slot[order], return_index=True)
            if len(met):
                count[met] += np.diff(np.append(at, len(slot)))
                total[met] += np.add.reduceat(x[order], at, axis=0)
        met = np.flatnonzero(count)
        sums = pa.ListArray.from_arrays(np.arange(0, width * len(met) + 1, width, dtype=np.int32), pa.array(total[met].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(count[met]), sums], ["slot", "n", "sums"])

    partial = rows.select("x", "code").mapInArrow(batches, "slot long, n long, sums array<long>")
    out = books.reshape(-1, width).copy()
    for slot, count, *sums in partial.groupBy("slot").agg(F.sum("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]).toLocalIterator():
        out[slot] = [s // count for s in sums]
    return out.reshape(books.shape)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train_codes(table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, key: str = "vec_id", column: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(key, label, code, error, scanned) of each usable row, and the codebooks by part, entry and position.

    Entries become floor(scale * entry), and vectors are cut into equal consecutive parts. The codebooks begin as the parts of the rows with the smallest keys
    (nulls last, ties by vector). Each round assigns every part to its codebook's nearest entry, ties to the lower index, and moves every entry that has parts to the floor of
    their mean; at the end parts are assigned again. code: a byte for each part; error: squared distances over all parts.

    Yinyang: entries of a codebook are put into groups once. A row keeps, for each part and group, a lower bound of its distance to the group's entries but the one it has. After a move the
    bounds fall by the group's farthest move, and only groups whose bound doesn't clear the exact distance to the entry at hand are scanned. Bounds are slack; distances that decide, and
    ties, are compared in integers. scanned: groups looked at, the sum of a batch on its first row. Each round's rows are written, with their bounds, to the shared folder.

    Rows whose vector is null, empty, shorter than the longest, or holds null, NaN or infinite entries are left out. With fewer usable rows than entries, codebooks have as many entries as rows;
    without any, no rows and codebooks of no entries. A length that isn't a multiple of parts, more than 256 entries, and figures whose squared distances pass a long raise ValueError.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: entries must be from 1 to 256")
    rows, length, most = integer_vectors(table, column, scale, key=key, label=label)
    if not length:
        return rows.select("key", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("scanned")).where("false"), np.zeros((parts, 0, 0), np.int64)
    if length % parts:
        raise ValueError(f"vectors of {length} entries can't be cut into {parts} equal parts")
    if length * (2 * most) ** 2 >= 1 << 63:
        raise ValueError(f"entries of up to {most} have squared distances beyond a long")
    first = rows.orderBy(F.col("key").asc_nulls_last(), "x").select("x").limit(entries).collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    groups = [grouped(b, -(-len(first) // PER_GROUP)) for b in books]
    before = None
    for _ in range(rounds):
        rows = written(assigned(rows, books, groups, before), "codes")
        before, books = books, moved(rows, books)
    return written(assigned(rows, books, groups, before).drop("x", "bounds"), "codes"), books


def compress(table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of each usable row: train_codes with code in hex and the error summed over equal labels, nulls together."""
    codes, books = train_codes(table, parts, entries, rounds, scale, key, column, label)
    totals = written(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    own = codes.alias("c").join(totals.alias("t"), F.col("c.label").eqNullSafe(F.col("t.label")))
    return own.select(F.col("c.key").alias(key), F.lower(F.hex("c.code")).alias("code"), "c.error", "t.label_error", F.lit(digest(books)).alias("codebooks_sha256"))
