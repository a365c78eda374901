"""Token hashes of many texts at once."""

from __future__ import annotations

import numpy as np

#: texts are hashed together up to about so many bytes
GROUP_BYTES = 1 << 21

# hash constants: odd multipliers
_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_CLASS = np.zeros(256, dtype=np.uint8)  # what a byte counts as: 0 separates tokens
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _CLASS[_b] = ord(chr(_b).lower()) if _b < 128 else _b


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    x = (x ^ (x >> np.uint64(29))) * _M
    return x ^ (x >> np.uint64(32))


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, and for each text the index of its first one (one more at the end).

    A token is a run of ASCII letters, ASCII digits and bytes from 128 on; A-Z count as a-z.
    """
    joined = b" ".join(texts) + b" "
    chars = _CLASS[np.frombuffer(joined, dtype=np.uint8)]
    inside = np.concatenate(([False], chars > 0))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    powers = np.cumprod(np.full(len(chars) + 1, _P, dtype=np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(chars * powers[:-1])))
    back = np.cumprod(np.full(len(chars) + 1, _P_INVERSE, dtype=np.uint64))
    # the sum over a token, shifted back to where it would start at 0
    hashes = mix((sums[ends] - sums[starts]) * back[starts])
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return hashes, np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the mask laid at each token; as many as it fits."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, len(mask), dtype=np.uint64)
    for i, read in enumerate(mask):
        if read == "1":
            total = total * _P + hashes[i : i + n]
    return mix(total)


def groups(batches):
    """(keys, texts as bytes) of about GROUP_BYTES each."""
    for batch in batches:
        start, size = 0, 0
        texts: list[bytes] = []
        for i, t in enumerate(batch.column(1)):
            texts.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
            size += len(texts[-1])
            if size >= GROUP_BYTES or i == batch.num_rows - 1:
                yield batch.column(0).slice(start, len(texts)), texts
                start, size, texts = i + 1, 0, []


def signed32(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
