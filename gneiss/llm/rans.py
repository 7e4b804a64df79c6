"""A static range asymmetric numeral system for token ids, in numpy.

A segment holds whole documents. One frequency table is shared by all its blocks; a block interleaves LANES coders,
token k of it going to lane k % LANES. The directory has a checkpoint for each block (where its words begin, and the
states its lanes start from) and its checksum, so that any block can be decoded by itself, or all at once.

Layout, little-endian: magic ``GNR1``; 9 u64: documents, tokens, blocks, steps, table bits, symbols, words, tokens before the segment in its part, and bytes of the zlib-compressed head; the head: doc ids (i64), their null marks (u8), token counts (u64), symbols
(u32), frequencies (u32), first word of each block (u64), CRC-32 of each block's ids (u32), lane states (u64); the words (u32).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"GNR1"
LANES = 32
BLOCK_TOKENS = 1 << 14
TABLE_BITS = 16
#: Ids under this are counted in a table.
DENSE = 1 << 22
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The symbols of ids, their frequencies that sum to a power of two, each at least 1, and that power's bits."""
    if int(ids.max()) < DENSE:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    bits = max(TABLE_BITS, len(symbols).bit_length() + 1)
    total = 1 << bits
    freq = np.maximum(1, counts * total // max(1, counts.sum())).astype(np.int64)
    order, k = np.argsort(-counts, kind="stable"), 0
    excess = int(freq.sum()) - total
    while excess:
        s = order[k % len(order)]
        step = -excess if excess < 0 else -min(excess, int(freq[s]) // 2)
        freq[s] += step
        excess += step
        k += 1
    return symbols.astype(np.uint32), freq.astype(np.uint32), bits


def encode(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, before: int = 0) -> bytes:
    """A segment of the documents with so many of the ids each; before: the tokens before it in its part."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n = len(ids)
    symbols, freq, bits = frequencies(ids) if n else (np.zeros(0, np.uint32), np.zeros(0, np.uint32), TABLE_BITS)
    blocks = -(-n // BLOCK_TOKENS)
    steps = -(-n // (blocks * LANES)) if n else 0
    if n and int(symbols[-1]) < DENSE:
        place = np.zeros(int(symbols[-1]) + 1, np.int64)
        place[symbols] = np.arange(len(symbols))
        place = place[ids]
    else:
        place = np.searchsorted(symbols, ids)
    if n:
        pad = blocks * LANES * steps - n
        place = np.concatenate((place, np.full(pad, int(np.argmax(freq))))).reshape(blocks, steps, LANES)
        f, start = freq.astype(np.uint64), np.concatenate((np.zeros(1, np.uint64), np.cumsum(freq.astype(np.uint64))[:-1]))
        place = np.ascontiguousarray(place.transpose(1, 0, 2)).reshape(steps, blocks * LANES)
        x = np.full(blocks * LANES, _LOW, np.uint64)
        out, full = np.zeros(place.shape, np.uint32), np.zeros(place.shape, bool)
        shift, limit = np.uint64(bits), np.uint64(63 - bits)
        for s in range(steps - 1, -1, -1):
            own = f[place[s]]
            over = x >= (own << limit)
            full[s], out[s] = over, x.astype(np.uint32)
            x = np.where(over, x >> _32, x)
            q = x // own
            x = (q << shift) + (x - q * own) + start[place[s]]
        mask = full.reshape(steps, blocks, LANES).transpose(1, 0, 2)
        words = out.reshape(steps, blocks, LANES).transpose(1, 0, 2)[mask]
        first = np.concatenate((np.zeros(1, np.int64), np.cumsum(mask.sum(axis=(1, 2)))[:-1])).astype(np.uint64)
        size = steps * LANES
        crcs = np.array([zlib.crc32(ids[k * size : (k + 1) * size].tobytes()) for k in range(blocks)], np.uint32)
    else:
        words, first, crcs, x = np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    keys = np.array([0 if d is None else d for d in doc_ids], np.int64)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    head = zlib.compress(b"".join(a.tobytes() for a in (keys, nulls, np.asarray(counts, np.uint64), symbols, freq, first, crcs, x)), 1)
    return MAGIC + struct.pack("<9Q", len(doc_ids), n, blocks, steps, bits, len(symbols), len(words), before, len(head)) + head + words.tobytes()


def decode(data: bytes, only: list[int] | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """(doc ids, token counts, ids, tokens before) of a segment; of the blocks listed in only, just their ids.

    A wrong checksum, magic or length raises ValueError.
    """
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    docs, n, blocks, steps, bits, n_symbols, n_words, before, n_head = struct.unpack_from("<9Q", data, 4)
    head, at, fields = zlib.decompress(data[76 : 76 + n_head]), 0, []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u4", n_symbols), ("<u4", n_symbols), ("<u8", blocks), ("<u4", blocks), ("<u8", blocks * LANES)):
        fields.append(np.frombuffer(head, kind, count, at))
        at += fields[-1].nbytes
    keys, nulls, counts, symbols, freq, first, crcs, states = fields
    words = np.frombuffer(data, "<u4", n_words, 76 + n_head).astype(np.uint64)
    chosen = np.arange(blocks) if only is None else np.array(only, np.int64)
    doc_ids = [None if z else int(k) for k, z in zip(keys.tolist(), nulls.tolist())]
    if not n:
        return doc_ids, counts.astype(np.int64), np.zeros(0, np.uint32), before
    of_slot = np.repeat(np.arange(n_symbols), freq)
    start = np.concatenate((np.zeros(1, np.int64), np.cumsum(freq.astype(np.int64))[:-1]))
    f_slot, bias = freq[of_slot].astype(np.uint64), (np.arange(1 << bits) - start[of_slot]).astype(np.uint64)
    symbol = symbols[of_slot]
    x = states.reshape(blocks, LANES)[chosen].astype(np.uint64)
    read = first[chosen].astype(np.int64)
    words = np.append(words, np.uint64(0))
    out, low, shift = np.empty((steps, len(chosen), LANES), np.uint32), np.uint64((1 << bits) - 1), np.uint64(bits)
    for s in range(steps):
        slot = (x & low).astype(np.int64)
        out[s] = symbol[slot]
        x = f_slot[slot] * (x >> shift) + bias[slot]
        need = x < _LOW
        upto = np.cumsum(need, axis=1)
        x = np.where(need, (x << _32) | words[np.minimum(read[:, None] + upto - 1, n_words)], x)
        read += upto[:, -1]
    size = steps * LANES
    got = np.ascontiguousarray(out.transpose(1, 0, 2)).reshape(len(chosen), size)
    ids = [got[k, : min(size, n - int(b) * size)] for k, b in enumerate(chosen)]
    for k, b in enumerate(chosen):
        if zlib.crc32(ids[k].tobytes()) != crcs[b]:
            raise ValueError(f"block {b} has a wrong checksum")
    return doc_ids, counts.astype(np.int64), np.concatenate(ids), before
