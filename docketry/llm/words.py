"""Words of texts, their 64-bit hashes and hashed shingles, for the operators on word sequences.

:func:`sequences` hashes the words of many texts at once, over the bytes of all of them; no word becomes an object.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

from docketry.llm.characters import PLAIN, compose, fold

#: Letters, digits and the signs that combine with them; the Devanagari full stop is none.
WORD = re.compile("[\\w%c-%c%c-%c%c-%c]+" % (0x300, 0x36F, 0x900, 0x963, 0x966, 0x97F))
#: The same for ASCII, byte for byte: letters in lower case, digits and _ stay, all else is a space.
_ASCII = bytes(ord(chr(c).lower()) if chr(c).isalnum() or c == 95 else 32 for c in range(128)) + bytes([32]) * 128
#: For UTF-8 of other texts, of which nothing but words, spaces and ASCII is left.
_OTHER = _ASCII[:128] + bytes(range(128, 256))
_IN_WORD: dict[str, bool] = {}
#: Characters of texts that are hashed at once.
AT_ONCE = 2_000_000

_P = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    """Words in order (UTF-8), letter case, punctuation, layout and the form of characters aside."""
    if text.isascii():
        return text.encode().translate(_ASCII).split()
    text = fold(text)
    if text.isascii():
        return text.encode().translate(_ASCII).split()
    return _only_words(text).translate(_OTHER).split()


def _only_words(text: str) -> bytes:
    """Folded text in lower case as UTF-8; beyond ASCII nothing is left but words."""
    text = text.lower()
    for c in set(text):
        if c > "\x7f":
            if c not in _IN_WORD:
                _IN_WORD[c] = WORD.match(c) is not None
            if not _IN_WORD[c]:
                text = text.replace(c, " ")
    return text.encode("utf-8", "surrogatepass")


def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = 1 << 16
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _P, np.uint64)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(_P), -1, 1 << 64)), np.uint64)]), dtype=np.uint64)
    return up, down


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _text(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


class Hasher:
    """64-bit hashes of the words in bytes of words and spaces: a polynomial over a word's bytes, mixed with its length.

    Its tables are made where it is made, in a task.
    """

    def __init__(self) -> None:
        self.up, self.down = _powers()
        self.to_plain = np.arange(0x110000, dtype=np.uint32)
        for c, to in PLAIN.items():
            self.to_plain[ord(c)] = ord(to) if to else self.GONE
        self.kind = np.zeros(0x110000, np.uint8)  # 0 not looked at, 1 in words, 2 in none
        self.kind[:128] = 1  # the bytes are looked at later

    GONE = np.uint32(0xFFFFFFFF)

    def joined(self, texts: list[str]) -> bytes:
        """Texts as UTF-8, folded, in lower case and beyond ASCII without what is in no word; the byte 0 between two."""
        codes = self.to_plain[_codes("\0".join(texts))]
        gone = codes == self.GONE
        whole = _text(codes[~gone] if gone.any() else codes)
        codes = _codes("\0".join(map(compose, whole.split("\0"))).lower())
        kind = self.kind[codes]
        if not kind.all():
            for c in set(codes[kind == 0].tolist()):
                self.kind[c] = 1 if WORD.match(chr(c)) else 2
            kind = self.kind[codes]
        return _text(np.where(kind == 2, np.uint32(32), codes)).encode("utf-8", "surrogatepass")

    def _of(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Words that lie within as many bytes as there are powers."""
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(b.astype(np.uint64) * self.up[: len(b)], dtype=np.uint64)])
            return (sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)

    def bytes(self, words: bytes) -> tuple[np.ndarray, np.ndarray]:
        """``(hashes, starts)`` of the words, in order."""
        b = np.frombuffer(words, np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], b > 32, [False]]).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        out, at, step = np.empty(len(starts), np.uint64), 0, len(self.up) - 1
        while at < len(starts):
            low = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, low + step, "right")))
            if int(ends[to - 1]) - low <= step:
                out[at:to] = self._of(b[low : ends[to - 1]], starts[at:to] - low, ends[at:to] - low)
            else:  # one word longer than all powers
                out[at] = int.from_bytes(xxhash.xxh3_64_digest(words[low : ends[at]]), "little")
            at = to
        return mix(out), starts

    def __call__(self, text: str) -> np.ndarray:
        return self.bytes(text.encode().translate(_ASCII) if text.isascii() else _only_words(fold(text)).translate(_OTHER))[0]


def sequences(texts: list[str], hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, first)``: hashes of the words of all texts in a row; text ``i`` has those from ``first[i]`` up to ``first[i + 1]``."""
    n = len(texts)
    texts = [t.replace("\0", " ") if "\0" in t else t for t in texts]
    counts, parts, order = np.zeros(n, np.int64), [], []
    for other in (False, True):
        these = [i for i, t in enumerate(texts) if t.isascii() != other]
        for low, high in _runs([len(texts[i]) for i in these]):
            some = these[low:high]
            raw = hasher.joined([texts[i] for i in some]) if other else "\0".join([texts[i] for i in some]).encode()
            borders = np.flatnonzero(np.frombuffer(raw, np.uint8) == 0)
            h, starts = hasher.bytes(raw.translate(_OTHER if other else _ASCII))
            counts[some] = np.diff(np.searchsorted(starts, np.concatenate([[0], borders, [len(raw)]])))
            parts.append(h)
            order += some
    first = np.concatenate([[0], np.cumsum(counts)])
    if not n:
        return np.zeros(0, np.uint64), first
    # from the order of hashing to that of the texts
    at = np.concatenate([[0], np.cumsum(counts[order])])
    places = np.repeat(first[order] - at[:-1], counts[order]) + np.arange(at[-1])
    out = np.empty(at[-1], np.uint64)
    out[places] = np.concatenate(parts)
    return out, first


def _runs(sizes: list[int]) -> list[tuple[int, int]]:
    """Runs of neighbours of about ``AT_ONCE`` in sum."""
    out, low, total = [], 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= AT_ONCE:
            out.append((low, i + 1))
            low, total = i + 1, 0
    if low < len(sizes):
        out.append((low, len(sizes)))
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, in order; a shorter text is one shingle, an empty one has none."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    with np.errstate(over="ignore"):
        out = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            out = out * _P + hashes[j : n - k + 1 + j]
    return mix(out)


def digest(hashes: np.ndarray) -> bytes:
    """128 bits that stand for the sequence of words."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence: one bit per element of ``a``, one step per element of ``b``."""
    head = 0
    for x, y in zip(a, b):  # noqa: B905
        if x != y:
            break
        head += 1
    a, b = a[head:], b[head:]
    tail = 0
    for x, y in zip(reversed(a), reversed(b)):  # noqa: B905
        if x != y:
            break
        tail += 1
    if tail:
        a, b = a[:-tail], b[:-tail]
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        m = at.get(y)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return head + tail + len(a) - row.bit_count()
