"""Patched frame-of-reference blocks for unsigned 32-bit ids, in numpy.

A block holds BLOCK ids. Its minimum is subtracted, the rest is packed at the width that a given percentile of the block
needs, and the ids above that width are kept whole in an exception list (positions, then values) after the packed words.
An index holds where each block starts. The last block is padded with its own last id.

A shard, little-endian: the magic, then n_ids, n_docs and n_blocks (u64 each); doc ids (i64) with a null mask (u8);
ids of each document (u32); block starts (u64), minima (u32), widths (u8), exception counts (u16); the blocks.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"GLPFOR01"
BLOCK = 256
PERCENTILE = 90
AT_ONCE = BLOCK << 12


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of 4 * width 64-bit words."""
    out = np.zeros((len(values), BLOCK * width // 64), np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        out[:, word] |= values[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= values[:, i] >> np.uint64(64 - shift)
    return out


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    out, mask = np.empty((len(words), BLOCK), np.uint64), np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        out[:, i] = value & mask
    return out


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def encode_ids(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The blocks, and by block its start, minimum, width and number of exceptions; AT_ONCE ids are worked on at a time."""
    parts = [_encode_some(ids[i : i + AT_ONCE], percentile) for i in range(0, len(ids), AT_ONCE)]
    if not parts:
        return b"", *(np.zeros(0, t) for t in (np.uint64, np.uint32, np.uint8, np.uint16))
    sizes = np.array([len(x[0]) for x in parts], np.uint64)
    starts = [x[1] + before for x, before in zip(parts, np.cumsum(sizes) - sizes, strict=True)]
    return b"".join(x[0] for x in parts), np.concatenate(starts), *(np.concatenate(x) for x in list(zip(*parts, strict=True))[2:])


def _encode_some(ids: np.ndarray, percentile: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n_blocks = -(-len(ids) // BLOCK)
    rows = np.concatenate([ids, np.repeat(ids[-1:], n_blocks * BLOCK - len(ids))]).astype(np.uint64).reshape(n_blocks, BLOCK)
    low = rows.min(1)
    rows = rows - low[:, None]
    at = min(BLOCK - 1, BLOCK * percentile // 100)
    width = np.frexp(np.partition(rows, at, axis=1)[:, at].astype(np.float64))[1].astype(np.int64)
    odd = rows >> width.astype(np.uint64)[:, None] != 0
    n_odd = odd.sum(1)
    sizes = 32 * width + 5 * n_odd
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width[width > 0]):
        at_w = np.flatnonzero(width == w)
        packed = _pack(rows[at_w] & np.uint64((1 << int(w)) - 1), int(w)).view(np.uint8).reshape(len(at_w), -1)
        out[starts[at_w][:, None] + np.arange(packed.shape[1])] = packed
    block, position = np.nonzero(odd)
    place, rank = (starts + 32 * width)[block], _within(n_odd)
    out[place + rank] = position
    values = rows[block, position].astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(place + n_odd[block] + 4 * rank)[:, None] + np.arange(4)] = values
    return out.tobytes(), starts.astype(np.uint64), low.astype(np.uint32), width.astype(np.uint8), n_odd.astype(np.uint16)


def decode_ids(blocks: bytes, starts: np.ndarray, low: np.ndarray, width: np.ndarray, n_odd: np.ndarray, n_ids: int) -> np.ndarray:
    data, starts, wide, odd = np.frombuffer(blocks, np.uint8), starts.astype(np.int64), width.astype(np.int64), n_odd.astype(np.int64)
    some = AT_ONCE // BLOCK
    parts = [_decode_some(data, starts[i : i + some], low[i : i + some], wide[i : i + some], odd[i : i + some]) for i in range(0, len(starts), some)]
    return np.concatenate(parts)[:n_ids] if parts else np.zeros(0, np.uint32)


def _decode_some(data: np.ndarray, starts: np.ndarray, low: np.ndarray, wide: np.ndarray, odd: np.ndarray) -> np.ndarray:
    rows = np.zeros((len(starts), BLOCK), np.uint64)
    for w in np.unique(wide[wide > 0]):
        at_w = np.flatnonzero(wide == w)
        words = np.ascontiguousarray(data[starts[at_w][:, None] + np.arange(32 * w)]).view("<u8")
        rows[at_w] = _unpack(words, int(w))
    block, rank = np.repeat(np.arange(len(starts)), odd), _within(odd)
    place = (starts + 32 * wide)[block]
    values = np.ascontiguousarray(data[(place + odd[block] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    rows[block, data[place + rank]] = values
    return (rows + low.astype(np.uint64)[:, None]).reshape(-1).astype(np.uint32)


def encode_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    blocks, starts, low, width, n_odd = encode_ids(ids, percentile)
    head = np.array([len(ids), len(doc_ids), len(starts)], "<u8").tobytes()
    docs = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], np.uint8).tobytes()
    index = (np.array(lengths, "<u4"), starts.astype("<u8"), low.astype("<u4"), width, n_odd.astype("<u2"))
    return MAGIC + head + docs + b"".join(x.tobytes() for x in index) + blocks


def decode_shard(shard: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths, and all ids."""
    if shard[:8] != MAGIC:
        raise ValueError("not a shard of token ids")
    n_ids, n_docs, n_blocks = (int(x) for x in np.frombuffer(shard, "<u8", 3, 8))
    at, parts = 32, []
    for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u8", n_blocks), ("<u4", n_blocks), ("u1", n_blocks), ("<u2", n_blocks)):
        parts.append(np.frombuffer(shard, kind, n, at))
        at += parts[-1].nbytes
    doc_ids, null, lengths, *index = parts
    ids = decode_ids(shard[at:], *index, n_ids)
    return [None if gone else int(x) for x, gone in zip(doc_ids, null, strict=True)], lengths, ids
