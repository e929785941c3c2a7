"""Canonical Huffman coding and payload framing for one block (numpy, bounded input)."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

CHUNK = 1024
"""Symbols per independently addressable run of bits."""
FEW_CHUNKS = 8
"""Up to so many runs are read one symbol after another; more are read side by side."""


def code_lengths(freq: np.ndarray) -> np.ndarray:
    """Code length of every symbol; a lone symbol needs no bits.

    Symbols in order of (frequency, index) and the nodes made so far, which come in ascending order
    of frequency, are two queues; a symbol goes first where both are equal. So no heap is needed.
    """
    n = len(freq)
    if n == 1:
        return np.zeros(1, np.uint8)
    leaves = np.argsort(freq, kind="stable").tolist()
    weight = np.asarray(freq).tolist() + [0] * (n - 1)
    parent = [0] * (2 * n - 1)
    leaf, made = 0, n  # heads of the queues
    for node in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if leaf < n and (made == node or weight[leaves[leaf]] <= weight[made]):
                child = leaves[leaf]
                leaf += 1
            else:
                child = made
                made += 1
            parent[child] = node
            total += weight[child]
        weight[node] = total
    depth = [0] * (2 * n - 1)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    return np.array(depth[:n], np.uint8)


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes for symbols sorted by (length, symbol): the room that shorter codes have taken, in units of 2^-length."""
    lengths = np.asarray(lengths).astype(np.uint64)
    longest = lengths.max(initial=0)
    room = np.uint64(1) << (longest - lengths)
    return (np.cumsum(room, dtype=np.uint64) - room) >> (longest - lengths)


def huffman_encode(values: np.ndarray) -> bytes:
    symbols, inverse, freq = np.unique(values, return_inverse=True, return_counts=True)
    if not len(symbols):
        return struct.pack("<QII", 0, 0, 0)
    lengths = code_lengths(freq)
    by = np.lexsort((symbols, lengths))
    symbols, lengths = symbols[by].astype("<i8"), lengths[by]
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    idx = place[inverse.ravel()]
    codes = canonical_codes(lengths)
    size = lengths[idx].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    shift = (np.repeat(ends, size) - 1 - np.arange(int(ends[-1]))).astype(np.uint64)
    bits = ((np.repeat(codes[idx], size) >> shift) & np.uint64(1)).astype(np.uint8)
    head = struct.pack("<QII", len(idx), len(symbols), int(ends[-1]) & 0xFFFFFFFF)
    offsets = starts[::CHUNK].astype("<i8")
    return b"".join(
        (head, struct.pack("<Q", int(ends[-1])), symbols.tobytes(), lengths.tobytes(),
         offsets.tobytes(), np.packbits(bits).tobytes())
    )


def huffman_decode(blob: bytes) -> np.ndarray:
    n, n_sym, _ = struct.unpack_from("<QII", blob)
    if n == 0:
        return np.zeros(0, np.int64)
    (n_bits,) = struct.unpack_from("<Q", blob, 16)
    at = 24
    symbols = np.frombuffer(blob, "<i8", n_sym, at)
    at += 8 * n_sym
    lengths = np.frombuffer(blob, np.uint8, n_sym, at)
    at += n_sym
    chunks = -(-n // CHUNK)
    pos = np.frombuffer(blob, "<i8", chunks, at).copy()
    at += 8 * chunks
    if n_sym == 1:
        return np.full(n, symbols[0])
    longest = int(lengths.max())
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=at), count=n_bits)
    padded = np.concatenate((bits, np.zeros(longest, np.uint8)))
    window = np.zeros(n_bits + 1, np.uint64)
    for j in range(longest):
        window = (window << np.uint64(1)) | padded[j : j + n_bits + 1]
    first = canonical_codes(lengths) << (longest - lengths).astype(np.uint64)
    hit = np.searchsorted(first, window, side="right") - 1
    step = lengths[hit].astype(np.int64)
    if chunks <= FEW_CHUNKS:
        follows = (np.arange(n_bits + 1) + step).tolist()
        at, walk = 0, []
        for _ in range(n):
            walk.append(at)
            at = follows[at]
        return symbols[hit[walk]]
    out = np.empty((CHUNK, chunks), np.int64)
    last = n_bits
    for i in range(min(CHUNK, n)):
        out[i] = hit[pos]
        pos = np.minimum(pos + step[pos], last)
    return symbols[out.T.ravel()[:n]]


def pack(sections: list[bytes]) -> bytes:
    """Length-prefixed sections behind one zstd frame, preceded by the plain size."""
    plain = b"".join(struct.pack("<Q", len(s)) + s for s in sections)
    return struct.pack("<Q", len(plain)) + pa.compress(plain, codec="zstd", asbytes=True)


def unpack(payload: bytes) -> list[bytes]:
    (size,) = struct.unpack_from("<Q", payload)
    plain = pa.decompress(payload[8:], decompressed_size=size, codec="zstd", asbytes=True)
    out, at = [], 0
    while at < size:
        (length,) = struct.unpack_from("<Q", plain, at)
        out.append(plain[at + 8 : at + 8 + length])
        at += 8 + length
    return out
