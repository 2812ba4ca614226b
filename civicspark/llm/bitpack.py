"""Fixed-width bit packing in numpy: every id takes the same number of bits, so any range can be read alone."""

from __future__ import annotations

import numpy as np

LANES = 64


def width(vocabulary: int) -> int:
    """The least number of bits that holds ids 0 .. vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit stream; 64 ids fill ``bits`` whole 64-bit words, the last group is padded with zeros."""
    if len(ids) and (int(ids.max()) >> bits or int(ids.min()) < 0):
        raise ValueError(f"an id does not fit in {bits} bits")
    groups = -(-len(ids) // LANES)
    lanes = np.zeros(groups * LANES, np.uint64)
    lanes[:len(ids)] = ids
    lanes = lanes.reshape(groups, LANES)
    words = np.zeros((groups, bits), np.uint64)
    for i in range(LANES):
        at, shift = divmod(i * bits, 64)
        words[:, at] |= lanes[:, i] << np.uint64(shift)
        if shift + bits > 64:
            words[:, at + 1] |= lanes[:, i] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` as unsigned 32-bit integers; touches only the groups that hold them."""
    first, last = start // LANES, -(-stop // LANES)
    words = np.frombuffer(payload, "<u8", (last - first) * bits, first * bits * 8).reshape(-1, bits)
    out = np.empty((len(words), LANES), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for i in range(LANES):
        at, shift = divmod(i * bits, 64)
        value = words[:, at] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, at + 1] << np.uint64(64 - shift))
        out[:, i] = value & mask
    return out.reshape(-1)[start - first * LANES:stop - first * LANES]
