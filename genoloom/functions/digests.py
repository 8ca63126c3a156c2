"""md5 of many short texts at once: the keyed orders and draws of Python tasks."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_ADD = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_FIRST = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts a round: the words stay in the processor's cache.
_ROUND = 8_192


class Texts:
    """Texts (utf-8 bytes) that get a common prefix and are digested together, again and again."""

    def __init__(self, texts: list[bytes]) -> None:
        self.texts = texts
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.most = int(self.size.max(initial=0))
        fits = self.most < 56
        flat = b"".join(t.ljust(self.most, b"\0") for t in texts) if fits else b""
        self.chars = np.frombuffer(flat, np.uint8).reshape(len(texts), self.most) if fits else None

    def md5(self, prefix: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The first and the second eight bytes of md5(prefix + text) as numbers: they order as the hexadecimal text does."""
        n = len(self.texts)
        high, low = np.empty(n, np.uint64), np.empty(n, np.uint64)
        if len(prefix) + self.most > 55 or self.chars is None:  # more than one block of 64 bytes
            for i, t in enumerate(self.texts):
                x = hashlib.md5(prefix + t).digest()
                high[i], low[i] = int.from_bytes(x[:8], "big"), int.from_bytes(x[8:], "big")
            return high, low
        head = np.frombuffer(prefix, np.uint8)
        for at in range(0, n, _ROUND):
            end = min(n, at + _ROUND)
            x = _blocks(head, self.chars[at:end], self.size[at:end])
            high[at:end], low[at:end] = x[:, :2].copy().view(">u8")[:, 0], x[:, 2:].copy().view(">u8")[:, 0]
        return high, low


def _blocks(head: np.ndarray, chars: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Digests (rows of four words, in the byte order of md5) of messages of one block."""
    n, end = len(chars), len(head) + size
    held = -(-(len(head) + chars.shape[1] + 1) // 4)
    raw = np.zeros((n, 4 * held), np.uint8)
    raw[:, : len(head)] = head
    raw[:, len(head) : len(head) + chars.shape[1]] = chars
    raw[np.arange(n), end] = 0x80
    word: list = [None] * 16
    for i, w in enumerate(np.ascontiguousarray(raw.view("<u4").T)):
        word[i] = w
    bits = (8 * end).astype(np.uint32)
    word[14] = bits
    a, b, c, d = (np.full(n, x, np.uint32) for x in _FIRST)
    f, r = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
            g = 7 * i % 16
        np.add(f, a, out=f)
        np.add(f, np.uint32(_ADD[i]), out=f)
        if word[g] is not None:
            np.add(f, word[g], out=f)
        np.right_shift(f, np.uint32(32 - _TURN[i]), out=r)
        np.left_shift(f, np.uint32(_TURN[i]), out=f)
        np.bitwise_or(f, r, out=f)
        np.add(f, b, out=a)  # the old a is no longer read
        a, b, c, d = d, a, b, c
    out = np.empty((n, 4), "<u4")
    for i, (x, y) in enumerate(zip((a, b, c, d), _FIRST)):
        out[:, i] = x + np.uint32(y)
    return out
