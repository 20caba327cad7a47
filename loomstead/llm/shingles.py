"""Word-shingle sets of whole texts as sorted 64-bit hashes, vectorised over a batch of texts.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased.  A set holds the
distinct hashes of ``size`` words in a row; a text with fewer words is one shingle, a text without
words has an empty set.
"""

from __future__ import annotations

import re

import numpy as np

#: Bytes of a text that are worked on at once.
BLOCK = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_B = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(n, np.uint64(_B), np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS[:n]


def _word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word of a buffer: the sum of its bytes times base powers, by offset in the word."""
    space = _SPACE[buf]
    solid = ~space
    first = np.flatnonzero(solid & np.concatenate([[True], space[:-1]]))
    last = np.flatnonzero(solid & np.concatenate([space[1:], [True]])) + 1
    if not len(first):
        return first, np.zeros(0, np.uint64)
    width = last - first
    inside = np.flatnonzero(solid)
    offset = np.arange(len(inside)) - np.repeat(np.cumsum(width) - width, width)
    value = (_LOWER[buf[inside]] + np.uint64(1)) * _powers(int(width.max()))[offset]
    return first, _mix(np.add.reduceat(value, np.cumsum(width) - width) + width.astype(np.uint64))


def _long_word(raw: bytes) -> np.uint64:
    """The hash of one very long word, block by block."""
    total, scale = 0, 1
    step = pow(_B, BLOCK, _MASK + 1)
    for lo in range(0, len(raw), BLOCK):
        part = np.frombuffer(raw, np.uint8, min(BLOCK, len(raw) - lo), lo)
        total += scale * int(np.add.reduce((_LOWER[part] + np.uint64(1)) * _powers(len(part))))
        scale = scale * step & _MASK
    return _mix(np.array([(total + len(raw)) & _MASK], np.uint64))[0]


def _long_words(text: bytes) -> np.ndarray:
    """The hashes of a long text's words, made in blocks that end at spaces."""
    out, lo = [], 0
    while lo < len(text):
        hi = len(text)
        if hi - lo > BLOCK:
            gap = _GAP.search(text, lo + BLOCK)
            hi = gap.start() if gap else hi
        part = text[lo:hi]
        if len(part) > 4 * BLOCK:
            # A word of more than a block stands at the end; what comes before it is an ordinary block.
            cut = max((m.end() for m in _GAP.finditer(part, 0, BLOCK)), default=0)
            if cut:
                out.append(_word_hashes(np.frombuffer(part, np.uint8, cut))[1])
            word = part[cut:]
            out.append(np.array([_long_word(word)], np.uint64) if word else np.zeros(0, np.uint64))
        else:
            out.append(_word_hashes(np.frombuffer(part, np.uint8))[1])
        lo = hi
    return np.concatenate(out)


def _fold(words: list[np.ndarray], there: list) -> np.ndarray:
    """Shingle hashes from the words of each place, of which some may be missing."""
    h = np.zeros(len(words[0]), np.uint64)
    for k, (word, ok) in enumerate(zip(words, there)):
        h = _mix(h * np.uint64(_B) + np.where(ok, word, np.uint64(0)) + np.uint64(k + 1))
    return h


def _long_set(text: bytes, size: int) -> np.ndarray:
    word = _long_words(text)
    n = len(word)
    if n < size:
        return _fold([word[k : k + 1] if k < n else np.zeros(1, np.uint64) for k in range(size)], [k < n for k in range(size)]) if n else word
    parts = []
    for lo in range(0, n - size + 1, BLOCK // 4):
        hi = min(n - size + 1, lo + BLOCK // 4)
        parts.append(np.unique(_fold([word[lo + k : hi + k] for k in range(size)], [True] * size)))
    return np.unique(np.concatenate(parts))


def shingle_sets(texts: list[bytes], size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the texts' sets one after another, each sorted, and the size of each set.

    Texts of more than a block are worked through block by block, at about 40 bytes a word.
    """
    with np.errstate(over="ignore"):
        long = [k for k, t in enumerate(texts) if len(t) > BLOCK]
        if not long:
            return _short_sets(texts, size)
        sets: list[np.ndarray] = []
        h, counts = _short_sets([b"" if len(t) > BLOCK else t for t in texts], size)
        ends = np.cumsum(counts)
        for k, t in enumerate(texts):
            sets.append(_long_set(t, size) if len(t) > BLOCK else h[ends[k] - counts[k] : ends[k]])
        return np.concatenate(sets), np.array([len(s) for s in sets], np.int64)


def _short_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    first, word = _word_hashes(buf)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    doc = np.searchsorted(begins, first, side="right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    start = np.cumsum(n_words) - n_words
    # Shingles: one for each word that has size - 1 words after it in its text, or the text's first word if it is short.
    n_shingles = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), n_shingles)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles) + start[owner]
    there = [k < n_words[owner] for k in range(size)]
    h = _fold([word[np.minimum(at + k, len(word) - 1)] for k in range(size)], there)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(texts))
