"""md5 of many short texts at once, for null models that hash every unit in every replicate."""

from __future__ import annotations

import hashlib

import numpy as np

_K = (np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)
_S = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_G = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
#: Bytes of a text that fit one block.
MOST = 55


def blocks(texts: np.ndarray, lead: int) -> np.ndarray | None:
    """16 rows of words, a column a text (bytes), each behind `lead` bytes left empty for a prefix; None if a text needs a second block."""
    size = np.char.str_len(texts).astype(np.int64) + lead
    if len(size) and size.max() > MOST:
        return None
    width = texts.dtype.itemsize
    out = np.zeros((len(texts), 64), np.uint8)
    take = min(width, MOST - lead)
    out[:, lead:lead + take] = texts.view(np.uint8).reshape(len(texts), width)[:, :take]
    out[np.arange(len(texts)), size] = 0x80
    out[:, 56:58] = (size * 8).astype("<u2").view(np.uint8).reshape(-1, 2)
    return np.ascontiguousarray(out.view("<u4").T)


def md5(words: np.ndarray, prefix: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The digests' first and last eight bytes as numbers that sort as the hexadecimal text does."""
    m = list(words)
    filled = np.frombuffer(prefix.ljust(-(-len(prefix) // 4) * 4, b"\0"), "<u4")
    for i, x in enumerate(filled):
        m[i] = m[i] | x
    n = words.shape[1]
    first = [np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = first
    for i in range(64):
        if i < 16:
            f = ((c ^ d) & b) ^ d
        elif i < 32:
            f = ((b ^ c) & d) ^ c
        elif i < 48:
            f = b ^ c ^ d
        else:
            f = c ^ (b | ~d)
        f += a
        f += m[_G[i]]
        f += _K[i]
        up = f << np.uint32(_S[i])
        f >>= np.uint32(32 - _S[i])
        up |= f
        up += b
        a, d, c, b = d, c, b, up
    a, b, c, d = ((x + y).byteswap().astype(np.uint64) for x, y in zip((a, b, c, d), first))
    return a << np.uint64(32) | b, c << np.uint64(32) | d


def md5_one_by_one(texts: np.ndarray, prefix: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The same for texts of any length."""
    both = np.frombuffer(b"".join(hashlib.md5(prefix + t).digest() for t in texts.tolist()), ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]
