"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from gneiss.llm.components import components
from gneiss.llm.filters import maybe_in
from gneiss.llm.session import free_name, only_cache, small_batches, text_or_empty, written
from gneiss.llm.words import mix, shingles, slices, words

BITS = 64
SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 14
#: Of near copies: words in the shingles that find them and in those that judge them, 32-bit SimHashes that are
#: searched, 64-bit ones that judge, and the most bits in which those may differ: cos(pi * 90 / 512) = 0.85.
PAIR, FIVE, TABLES, CHECKS, MOST_BITS = 2, 5, 8, 8, 90
#: Nodes of one print that are compared as a block, and pairs that are compared at once.
NODES_IN_BLOCK, PAIRS_AT_ONCE = 256, 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The text's 64-bit SimHash over its word shingles, repeats included; 0 without words.

    A-Z is lower-cased; words are runs of anything but ASCII white space; a text of fewer words than a shingle has
    is one shingle. A bit is 1 if it is set in over half of the shingles' XXH64 hashes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < shingle:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, len(starts), BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist())], "<u8")
        counts += bit_counts(hashes)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, name: str, shingle: int = 3, text: str = "text") -> DataFrame:
    """docs' other columns and the fingerprint of each text as a signed long named name; the text is left behind."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text]
    given = docs.select(*[F.col(f"`{c}`") for c in rest], text_or_empty(f"`{text}`").alias(free_name(docs, "simhash_text")))
    schema = given.select(*[F.col(f"`{c}`") for c in rest]).schema.add(name, "long")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            prints = np.array([fingerprint(t, shingle) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints, pa.int64())], [*rest, name])

    return given.mapInArrow(batches, schema)


def ball(radius: int) -> list[int]:
    """The masks of at most radius set bits, as signed longs."""
    found = frontier = {0}
    for _ in range(radius):
        frontier = {m ^ (1 << b) for m in frontier for b in range(BITS)}
        found = found | frontier
    return sorted(m - (1 << BITS) if m >> (BITS - 1) else m for m in found)


def near_pairs(prints: DataFrame, name: str, radius: int = 2) -> DataFrame:
    """(a, b): links between different fingerprints that connect all pairs at most radius bits apart.

    prints: distinct fingerprints. Every fingerprint emits all variants within half the radius; two at most radius
    bits apart share one, and all that share one are at most radius bits apart. So each variant's fingerprints are
    linked to their smallest one, which loses no component and makes no pairs within a group; a variant has at most
    as many fingerprints as the half ball has masks. The links are deduplicated and verified.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    masks = ball(radius // 2)
    variants = prints.select(F.col(name).alias("a"), F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: m.bitwiseXOR(F.col(name)))).alias("variant"))
    shared = variants.groupBy("variant").agg(F.min("a").alias("low"), F.collect_list("a").alias("all")).where(F.size("all") > 1)
    pairs = shared.select(F.col("low").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id): fingerprint in 16 hex digits, component_id the smallest key reachable.

    Documents link where their fingerprints differ in at most radius bits. One row per row of docs: rows that
    repeat a key keep their own fingerprints; null keys are kept, and are a group's component_id only where it
    has no other key. Null and empty texts and texts of white space have fingerprint zero and link like any others. Other
    columns are left out.
    """
    prints = with_fingerprints(docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text")), "fp", shingle)
    prints = written(prints, "simhash")
    owners = written(prints.groupBy("fp").agg(F.min("doc").alias("least")), "simhash-owners")
    groups = components(near_pairs(owners.select("fp"), "fp", radius)).withColumnRenamed("node", "fp")
    tops = owners.join(groups, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("top"))
    least = tops.groupBy("top").agg(F.min("least").alias("component_id"))
    ids = tops.join(least, "top").select("fp", "component_id")
    return prints.join(ids, "fp").select(F.col("doc").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """Of each of the 64 bits, lowest first, in how many of the hashes it is set."""
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(np.ascontiguousarray(hashes[k : k + BLOCK], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255  # sums of so many bits fit their bytes
        total += np.add.reduce(bits[:whole].reshape(-1, 255, BITS), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.int64)
    return total


def sketch(hashes: np.ndarray, n: int) -> np.ndarray:
    """n independent 64-bit SimHashes of a text's shingle hashes."""
    out = np.zeros(n, np.uint64)
    for k in range(n):
        counts = bit_counts(mix(hashes + np.uint64((k * 0x9E3779B97F4A7C15) % (1 << 64))))
        out[k] = np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]
    return out


def text_sketches(column: pa.Array, tables: int, checks: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each text a digest of its words, `tables` 32-bit SimHashes over pairs of words and `checks` 64-bit ones over shingles of five.

    A text of fewer words than a shingle has is one shingle of all its words; without words all are 0.
    """
    for lo, hi in slices(column):
        found = words(column.slice(lo, hi - lo))
        plain = found.hashes()
        pairs, fives = shingles(found, plain, PAIR), shingles(found, plain, FIVE)
        for k in range(hi - lo):
            own = plain[found.first[k] : found.first[k + 1]]
            if not len(own):
                yield 0, np.zeros(tables, np.uint32), np.zeros(checks, np.uint64)
                continue
            whole = np.array([xxhash.xxh64_intdigest(own.tobytes(), 1)], np.uint64)
            runs = [h[first[k] : first[k + 1]] if len(own) >= size else whole for (h, first), size in ((pairs, PAIR), (fives, FIVE))]
            yield int(whole[0]), sketch(runs[0], -(-tables // 2)).view(np.uint32)[:tables], sketch(runs[1], checks)


def similar_groups(docs: DataFrame, tables: int = TABLES, checks: int = CHECKS, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, text_key, node, top) of every distinct doc_id and text: top is the same for all of a group of near copies.

    text_key: xxhash64 of the text. Texts of equal words (A-Z lower-cased) are one node. Two nodes are candidates where one of their 32-bit
    SimHashes over pairs of words is at most 2 bits apart, which ball hashing finds as in near_pairs; they link where
    the 64-bit SimHashes over shingles of five words differ in at most most_bits bits altogether. With the default, that
    is where the share of equal shingles (their Jaccard similarity) is estimated at 0.74 or more: a pair of 0.8 links with
    a probability of 0.93, one of 0.6 with 0.002.

    All candidates are compared, but those that verified links already join: nodes that share a 32-bit SimHash are first
    compared with one of them, which differs from table to table, so that a large group of copies holds together by
    few links. Then each SimHash's nodes are put in blocks of a bounded number, and blocks of one SimHash, and of two
    at most 2 bits apart, are compared node by node (linked_tops).
    """
    small_batches(docs.sparkSession)
    given = docs.select("doc_id", F.xxhash64("text").alias("text_key"), text_or_empty().alias("text"))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache(None)
        for batch in found:
            got = list(text_sketches(batch.column(2), tables, checks))
            nodes = np.array([g[0] for g in got], np.uint64).view(np.int64)
            prints = pa.array([g[1].tolist() for g in got], pa.list_(pa.int64()))
            check = pa.array([g[2].view(np.int64).tolist() for g in got], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), prints, check], ["doc_id", "text_key", "node", "prints", "checks"])

    schema = given.select("doc_id", "text_key").schema.add("node", "long").add("prints", ArrayType(LongType())).add("checks", ArrayType(LongType()))
    found = written(given.mapInArrow(batches, schema), "near")
    nodes = written(found.groupBy("node").agg(F.first("prints").alias("prints"), F.first("checks").alias("checks")), "near-nodes")
    values = _values(nodes, "node")
    heads = values.groupBy("key").agg(F.min_by("node", F.xxhash64("key", "node")).alias("head"))
    shared = values.join(heads, "key").where("node <> head")
    pairs = written(shared.select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct(), "near-pairs")
    left = nodes.select(F.col("node").alias("a"), F.col("checks").alias("ca"))
    right = nodes.select(F.col("node").alias("b"), F.col("checks").alias("cb"))
    apart = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    linked = pairs.join(left, "a").join(right, "b").where(apart <= most_bits).select("a", "b")
    groups = components(linked).select("node", F.col("component").alias("top"))
    tops = written(nodes.select("node", "prints", "checks").join(groups, "node", "left").withColumn("top", F.coalesce("top", "node")), "near-tops")
    more = components(linked_tops(tops, most_bits)).select(F.col("node").alias("top"), "component")
    tops = tops.select("node", "top").join(more, "top", "left").select("node", F.coalesce("component", "top").alias("top"))
    return found.select("doc_id", "text_key", "node").distinct().join(tops, "node")


def _values(nodes: DataFrame, *columns: str) -> DataFrame:
    """columns and the key, table and value in one long, of each 32-bit SimHash of nodes' prints."""
    key = F.shiftleft(F.col("table").cast("long"), 32).bitwiseOR(F.col("value")).alias("key")
    return nodes.select(*columns, F.posexplode("prints").alias("table", "value")).select(*columns, key)


def linked_tops(nodes: DataFrame, most_bits: int, size: int = NODES_IN_BLOCK) -> DataFrame:
    """(a, b): links that connect the tops of all candidates of nodes (node, prints, checks, top) whose checks differ in at most most_bits bits.

    A key's nodes are dealt to blocks of about size nodes by their hashes, and the nodes of a top with so many at the
    key to blocks of their own; two blocks with one and the same top have nothing to link and are left out. Keys at most
    2 bits apart meet by ball hashing, 33 at a variant at most, whatever the number of their nodes.
    """
    own = _values(nodes, "node", "top", "checks")
    counts = written(_values(nodes, "top").groupBy("key", "top").agg(F.count("*").alias("n")), "near-counts")
    large = counts.where(F.col("n") >= size).select("key", "top", F.ceil(F.col("n") / size).alias("own_blocks"))
    mixed = counts.where(F.col("n") < size).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > size).select("key", F.ceil(F.col("n") / size).alias("blocks"))
    dealt = own.join(large, ["key", "top"], "left").join(mixed, "key", "left")
    lane = F.when(F.col("own_blocks").isNotNull(), F.col("top"))
    block = F.xxhash64(lane, F.pmod(F.xxhash64("node"), F.coalesce("own_blocks", "blocks", F.lit(1).cast("long"))))
    blocks = dealt.groupBy("key", block.alias("block")).agg(F.min("top").alias("low"), F.max("top").alias("high"), F.collect_list(F.struct("top", "checks")).alias("all"))
    blocks = written(blocks.select("key", "block", "low", "high", F.col("all.top").alias("tops"), F.flatten("all.checks").alias("checks")), "near-blocks")
    masks = [0, *(1 << b for b in range(32))]
    keys = counts.select("key").distinct()
    balls = keys.select("key", F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: m.bitwiseXOR(F.col("key")))).alias("variant"))
    met = balls.groupBy("variant").agg(F.collect_list("key").alias("all")).where(F.size("all") > 1)
    near = met.select(F.explode("all").alias("ka"), "all").select("ka", F.explode("all").alias("kb")).where("ka < kb").distinct()
    near = written(near, "near-keys")
    light = lambda x: blocks.select(*[F.col(c).alias(f"{c[0]}{x}") for c in ("key", "block", "low", "high")])
    full = lambda x: blocks.select(F.col("key").alias(f"k{x}"), F.col("block").alias(f"b{x}"), F.col("tops").alias(f"t{x}"), F.col("checks").alias(f"c{x}"))
    inside = light("a").withColumn("kb", F.col("ka")).join(light("b"), "kb").where("ba <= bb")
    across = near.join(light("a"), "ka").join(light("b"), "kb")
    meet = inside.unionByName(across).where("not (la = ha and lb = hb and la = lb)").select("ka", "ba", "kb", "bb")
    both = meet.join(full("a"), ["ka", "ba"]).join(full("b"), ["kb", "bb"]).select("ta", "ca", "tb", "cb")

    def links(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache(None)
        for batch in found:
            got = near_tops(*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in batch.columns), most_bits)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0], pa.int64()), pa.array(got[:, 1], pa.int64())], ["a", "b"])

    return written(both.mapInArrow(links, "a long, b long").distinct(), "near-links")


def near_tops(ta: pa.ListArray, ca: pa.ListArray, tb: pa.ListArray, cb: pa.ListArray, most_bits: int) -> np.ndarray:
    """Rows (a, b) that connect the tops of all pairs, of one node of ta and one of tb in the same row, whose checks differ in at most most_bits bits."""
    tops, first, size, checks = [], [], [], []
    for t, c in ((ta, ca), (tb, cb)):
        tops.append(t.flatten().to_numpy(zero_copy_only=False))
        ends = np.concatenate(([0], np.cumsum(t.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        first.append(ends[:-1])
        size.append(np.diff(ends))
        checks.append(c.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(tops[-1]), -1) if len(tops[-1]) else np.zeros((0, 1), np.uint64))
    ends = np.concatenate(([0], np.cumsum(size[0] * size[1])))
    out: list[np.ndarray] = []
    for lo in range(0, int(ends[-1]), PAIRS_AT_ONCE):
        at = np.arange(lo, min(lo + PAIRS_AT_ONCE, int(ends[-1])))
        row = np.searchsorted(ends, at, "right") - 1
        i, j = np.divmod(at - ends[row], size[1][row])
        i, j = first[0][row] + i, first[1][row] + j
        keep = tops[0][i] != tops[1][j]
        i, j = i[keep], j[keep]
        bits = np.zeros(len(i), np.int64)
        for k in range(checks[0].shape[1]):
            bits += np.bitwise_count(checks[0][i, k] ^ checks[1][j, k])
            if k % 4 == 3:  # those beyond the bound can't come back under it
                keep = bits <= most_bits
                i, j, bits = i[keep], j[keep], bits[keep]
        keep = bits <= most_bits
        out.append(_forest(np.unique(np.stack([tops[0][i[keep]], tops[1][j[keep]]], axis=1), axis=0)))
    return _forest(np.concatenate(out)) if out else np.zeros((0, 2), np.int64)


def _forest(links: np.ndarray) -> np.ndarray:
    """Those of links that connect as much as all of them, without circles."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    kept = []
    for a, b in links.tolist():
        x, y = top(a), top(b)
        if x != y:
            above[max(x, y)] = min(x, y)
            kept.append((a, b))
    return np.array(kept, np.int64).reshape(-1, 2)


def drop_near_copies(docs: DataFrame, **how: int) -> DataFrame:
    """docs with one row of each group of near copies (similar_groups): the one with the least doc_id, nulls last, then the least text_key.

    Rows that repeat both doc_id and text are copies too. All columns of docs stay. Empty texts are one group.
    """
    groups = written(similar_groups(docs, **how), "near-groups")
    rank = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_key")
    best = written(groups.groupBy("top").agg(F.min(rank).alias("best"), F.count("*").alias("n")).where("n > 1"), "near-best")
    gone_id, gone_key, key = (free_name(docs, n) for n in ("gone_id", "gone_key", "near_key"))
    gone = groups.join(best, "top").where(rank != F.col("best")).select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key))
    gone = written(gone, "near-gone")
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(key, F.xxhash64("text"))
    maybe = maybe_in(gone.select(F.xxhash64(gone_id, gone_key).alias("h")), F.xxhash64("doc_id", key))
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key))
    kept = keyed.where(~maybe).unionByName(keyed.where(maybe).join(gone, same, "left_anti"))
    again = docs.select(F.col("doc_id").alias(gone_id), F.xxhash64("text").alias(gone_key)).groupBy(gone_id, gone_key).count().where("count > 1").drop("count")
    again = written(again, "near-again")
    if again.isEmpty():
        return kept.select(*names)
    once = kept.join(again, same, "left_anti").select(*names, key)
    return once.unionByName(kept.join(again, same, "left_semi").select(*names, key).dropDuplicates(["doc_id", key])).select(*names)
