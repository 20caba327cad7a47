"""External induced sorting of suffixes: disk-backed bulk priority queues that carry suffix tuples and common prefixes.

A suffix is smaller (S) or larger (L) than its successor.  The leftmost S suffixes of a string are named by
their substrings, and the string of names is sorted by recursion, which also gives the common prefixes of
neighbours.  These suffixes seed a priority queue that yields all suffixes in ascending order: one that
comes out puts the one before it in, if that is of type L, keyed by its character, ties in order of arrival.
A second queue over the complemented alphabet induces the S suffixes from the L suffixes in the same way.

A queue tuple is (character, position, context, common prefix):

* the context holds the next few characters to the left, so the text need not be read for them; an empty
  context is filled from the text again;
* the common prefix is that with the suffix before it in its bucket: one more than the least common prefix
  between the two suffixes that induced them, cut at ``width``.  Where L and S suffixes of a character meet
  it is the shorter of their runs of that character.

Memory is bounded by ``limit``, not by the string.  Queues and finished suffixes past the bound go to files
without names; strings, star positions and ranks past the bound are arrays mapped from such files, read in
blocks or at positions.  A bucket of one character is worked off in blocks; a bucket of several rare
characters has about twice the square root of the string's length and is merged in memory.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of tuples that each queue or list of suffixes holds in memory before it goes to a file.
LIMIT = 12 << 20
#: Positions of a string that are read at once, and tuples that come out of a queue at once.
BLOCK, BATCH = 1 << 18, 1 << 15
_FAR = np.uint8(255)

Columns = tuple[np.ndarray, ...]


def space(n: int, kind, limit: int) -> np.ndarray:
    """An array for n values: in memory, or mapped from a file if it is large for the bound."""
    kind = np.dtype(kind)
    if n * kind.itemsize <= limit // 4 or not n:
        return np.zeros(n, kind)
    file = tempfile.TemporaryFile()
    file.truncate(n * kind.itemsize)
    return np.memmap(file, kind, "r+", shape=(n,))


class _File:
    """Blocks of columns in a temporary file."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()

    def write(self, columns: Columns) -> tuple:
        at = self.file.seek(0, 2)
        for c in columns:
            self.file.write(np.ascontiguousarray(c).tobytes())
        return at, len(columns[0]), tuple(c.dtype for c in columns)

    def read(self, place: tuple) -> Columns:
        at, n, kinds = place
        self.file.seek(at)
        return tuple(np.frombuffer(self.file.read(n * k.itemsize), k) for k in kinds)


class Sequence:
    """Columns appended in blocks and read in either direction; past ``limit`` bytes they go to a file."""

    def __init__(self, limit: int):
        self.limit, self.held, self.blocks, self.file, self.spilled = limit, 0, [], None, 0

    def append(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.blocks.append((columns, None))
            self.held += sum(c.nbytes for c in columns)
            if self.held > self.limit:
                self.file = self.file or _File()
                for k in range(self.spilled, len(self.blocks)):
                    self.blocks[k] = (None, self.file.write(self.blocks[k][0]))
                self.held, self.spilled = 0, len(self.blocks)

    def __iter__(self) -> Iterator[Columns]:
        return (c if place is None else self.file.read(place) for c, place in self.blocks)

    def backwards(self) -> Iterator[Columns]:
        """Blocks from the last to the first, each turned round."""
        return (tuple(x[::-1] for x in (c if place is None else self.file.read(place))) for c, place in reversed(self.blocks))


class BulkQueue:
    """Buckets of rows of 64-bit words, first in first out; past ``limit`` waiting bytes all of them go to a file."""

    def __init__(self, buckets: int, limit: int = LIMIT):
        self.limit, self.held, self.file, self.spills = limit, 0, None, 0
        self.waiting: list[list[np.ndarray]] = [[] for _ in range(buckets)]
        self.filed: list[list[tuple]] = [[] for _ in range(buckets)]

    def put(self, bucket: np.ndarray, rows: np.ndarray) -> None:
        """Rows in ascending order of bucket."""
        if not len(bucket):
            return
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        waiting = self.waiting
        for k, a, b in zip(bucket[cuts[:-1]].tolist(), cuts[:-1], cuts[1:]):
            waiting[k].append(rows[a:b])
        self.held += len(rows)
        if self.held * 8 * rows.shape[1] > self.limit:
            self.file, self.spills = self.file or _File(), self.spills + 1
            for k, parts in enumerate(waiting):
                if parts:
                    self.filed[k].append((self.file.write((np.concatenate(parts).ravel(),)), rows.shape[1]))
                    parts.clear()
            self.held = 0

    def has(self, bucket: int) -> bool:
        return bool(self.waiting[bucket] or self.filed[bucket])

    def drain(self, bucket: int) -> Iterator[np.ndarray]:
        """What waits in the bucket now, in order of arrival, in blocks."""
        filed, self.filed[bucket] = self.filed[bucket], []
        waiting, self.waiting[bucket] = self.waiting[bucket], []
        for place, wide in filed:
            yield self.file.read(place)[0].reshape(-1, wide)
        if waiting:
            rows = waiting[0] if len(waiting) == 1 else np.concatenate(waiting)
            self.held -= len(rows)
            yield rows


class _Text:
    """A string of characters below ``alphabet``, the last one the unique least, with its packing."""

    def __init__(self, chars: np.ndarray, alphabet: int, limit: int):
        self.chars, self.alphabet, self.limit, self.n = chars, alphabet, limit, len(chars)
        self.bits = int(alphabet).bit_length()
        self.each = max(1, 63 // self.bits)
        self.mask = np.uint64((1 << self.bits) - 1)
        self.position = np.dtype(np.int32 if self.n < 1 << 31 else np.int64)
        self.key = np.dtype(np.uint16 if 2 * alphabet < 1 << 16 else np.uint32 if 2 * alphabet < 1 << 32 else np.uint64)

    def context(self, at: np.ndarray) -> np.ndarray:
        """The characters before each position, the nearest lowest, under a mark bit."""
        out = np.zeros(len(at), np.uint64)
        for j in range(self.each):
            c = self.chars[np.maximum(at - 1 - j, 0)].astype(np.uint64)
            out |= np.where(at > j, c, np.uint64(0)) << np.uint64(self.bits * j)
        return out | np.uint64(1) << (np.minimum(at, self.each) * self.bits).astype(np.uint64)

    def words(self, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The characters from each position up to its end, packed so that words sort as they do; the finished are last."""
        out = np.zeros(len(at), np.uint64)
        for j in range(self.each):
            c = self.chars[np.minimum(at + j, ends)].astype(np.uint64)
            out = out << np.uint64(self.bits) | np.where(at + j <= ends, c, self.mask)
        return out

    def runs(self, at: np.ndarray, width: int) -> np.ndarray:
        """How often the character at each position follows itself there, cut at the width."""
        out = np.ones(len(at), np.uint8)
        live, first = np.arange(len(at)), self.chars[at]
        for d in range(1, width):
            live = live[self.chars[at[live] + d] == first[live]]
            if not len(live):
                break
            out[live] += np.uint8(1)
        return out

    def counts(self) -> np.ndarray:
        out = space(self.alphabet, np.int64, self.limit)
        for lo in range(0, self.n, BLOCK):
            values, n = np.unique(self.chars[lo : lo + BLOCK], return_counts=True)
            out[values] += n
        return out

    def stars(self) -> np.ndarray:
        """Positions of S suffixes behind an L suffix, found from the end in blocks."""
        found, hi, after, after_small = [], self.n, None, True
        while hi:
            lo = max(0, hi - BLOCK)
            c = np.asarray(self.chars[lo:hi])
            rises, differs = np.ones(len(c), bool), np.ones(len(c), bool)
            rises[:-1], differs[:-1] = c[:-1] < c[1:], c[:-1] != c[1:]
            if hi < self.n:
                rises[-1] = c[-1] < after or (c[-1] == after and after_small)
            settle = np.minimum.accumulate(np.where(differs, np.arange(len(c)), len(c))[::-1])[::-1]
            small = rises[settle]
            if hi < self.n and after_small and not small[-1]:
                found.append(np.array([hi], self.position))
            found.append((np.flatnonzero(small[1:] & ~small[:-1]) + 1 + lo).astype(self.position))
            after, after_small, hi = c[0], bool(small[0]), lo
        out, at = space(sum(map(len, found)), self.position, self.limit), 0
        for part in reversed(found):
            out[at : at + len(part)] = part
            at += len(part)
        return out


def _sorted_blocks(blocks: Iterator[Columns], splitters: np.ndarray, limit: int) -> Iterator[Columns]:
    """Rows of (key, second key, number) in order, by distribution to buckets between splitters; equal keys stay in one block."""
    queue = BulkQueue(len(splitters) + 1, limit)
    for key, second, number in blocks:
        bucket = np.searchsorted(splitters, key, side="right")
        order = np.argsort(bucket, kind="stable")
        queue.put(bucket[order], np.stack([key, second, number.astype(np.uint64)], axis=1)[order])
    for k in range(len(splitters) + 1):
        parts = list(queue.drain(k))
        if parts:
            key, second, number = np.concatenate(parts).T
            order = np.lexsort((second, key))
            yield key[order], second[order], number[order].astype(np.int64)


def _names(text: _Text, star: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks of the substrings from each star to the next (both included), a word at a time, and how many there are."""
    m, limit = len(star), text.limit
    cls, alone = space(m, text.position, limit), space(m, np.uint8, limit)
    parts = max(1, -(-m * 24 // limit))

    def at(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        begin = star[lo:hi].astype(np.int64)
        return begin, np.append(star[lo + 1 : hi + 1], [text.n - 1] if hi == m else []).astype(np.int64)

    def splitters(keys: np.ndarray, n: int) -> np.ndarray:
        return np.unique(np.sort(keys)[:: max(1, len(keys) // n)][1:]) if n > 1 else keys[:0]

    def first_round() -> Iterator[Columns]:
        for lo in range(0, m, BLOCK):
            begin, end = at(lo, min(m, lo + BLOCK))
            yield text.words(begin, end), np.zeros(len(begin), np.uint64), np.arange(lo, lo + len(begin))

    some = np.unique(np.linspace(0, m - 1, min(m, 20_000)).astype(np.int64))
    cuts = splitters(text.words(star[some].astype(np.int64), np.append(star[1:], star[-1:])[some].astype(np.int64)), parts)
    blocks, depth, before = _sorted_blocks(first_round(), cuts, limit), 0, 0
    while True:
        depth += text.each
        active = Sequence(limit)
        for key, second, i in blocks:
            group = np.concatenate([[True], key[1:] != key[:-1]])
            new = group | np.concatenate([[True], second[1:] != second[:-1]])
            place = np.arange(len(i))
            first = np.maximum.accumulate(np.where(new, place, 0))
            if depth == text.each:
                cls[i] = before + first
                before += len(i)
            else:
                cls[i] = key.astype(np.int64) + first - np.maximum.accumulate(np.where(group, place, 0))
            run = np.diff(np.append(np.flatnonzero(new), len(i)))
            again = i[np.repeat(run > 1, run)]
            size = np.append(star[1:], star[-1:])[again] - star[again] if len(again) < BLOCK else np.asarray(star)[np.minimum(again + 1, m - 1)] - star[again]
            active.append(np.sort(again[size + 1 >= depth]))  # one that ends just here comes after those that go on
        n = sum(len(c[0]) for c in active)
        if not n:
            break

        def next_round(active=active, depth=depth) -> Iterator[Columns]:
            for (i,) in active:
                begin, end = star[i].astype(np.int64) + depth, np.asarray(star)[np.minimum(i + 1, m - 1)].astype(np.int64)
                yield cls[i].astype(np.uint64), text.words(np.minimum(begin, end + 1), end), i

        cuts = splitters(np.concatenate([cls[c[0][:: max(1, n // 20_000)]] for c in active]).astype(np.uint64), max(1, -(-n * 24 // limit)))
        blocks = _sorted_blocks(next_round(), cuts, limit)
    for lo in range(0, m, BLOCK):
        alone[cls[lo : lo + BLOCK]] = 1
    rank, total = space(m, text.position, limit), 0
    for lo in range(0, m, BLOCK):
        part = np.cumsum(alone[lo : lo + BLOCK], dtype=np.int64) + total
        total = int(part[-1])
        rank[lo : lo + BLOCK] = part - 1
    for lo in range(0, m, BLOCK):
        cls[lo : lo + BLOCK] = rank[cls[lo : lo + BLOCK]]
    return cls, total


class _Lows:
    """The least of a row of numbers from any earlier place up to now."""

    def __init__(self):
        self.at, self.low, self.now = [], [], 0

    def push(self, low: int) -> None:
        while self.low and self.low[-1] >= low:
            self.at.pop()
            self.low.pop()
        self.at.append(self.now)
        self.low.append(low)
        self.now += 1

    def since(self, begin: np.ndarray) -> np.ndarray:
        return np.array([*self.low, 255], np.uint8)[np.searchsorted(np.array(self.at, np.int64), begin)]


def _range_least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of values[a..b], both included, for each pair."""
    level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    top = int(level.max()) if len(level) else 0
    table = np.empty((top + 1, len(values)), np.uint8)
    table[0] = values
    for k in range(1, top + 1):
        half = 1 << (k - 1)
        table[k] = table[k - 1]
        np.minimum(table[k - 1, :-half], table[k - 1, half:], out=table[k, :-half])
    return np.minimum(table[level, a], table[level, b - (1 << level) + 1])


class _Induction:
    """One queue's work: all suffixes of one type from sorted seeds of the other."""

    def __init__(self, text: _Text, counts: np.ndarray, flip: bool, width: int):
        self.text, self.flip, self.width = text, flip, np.uint8(width)
        if flip:
            counts = counts[::-1]
        step = min(max(256, 2 * int(text.n**0.5)), 1 << 15)
        quotient = (np.cumsum(counts) - counts) // step
        new = np.ones(len(counts), bool)
        big = counts > step
        new[1:] = (quotient[1:] != quotient[:-1]) | big[1:] | big[:-1]
        self.begin = np.append(np.flatnonzero(new), len(counts))
        self.bucket = space(len(counts), np.int32, text.limit)
        self.bucket[:] = np.cumsum(new) - 1
        # A tuple has 40 bits for the position and 16 for the character's place in its bucket.
        if text.n >= 1 << 40 or int(np.diff(self.begin).max()) > 1 << 16:
            raise ValueError("a string of this size or alphabet is not sorted here")
        self.queue = BulkQueue(len(self.begin) - 1, text.limit)
        self.since, self.tail = space(len(counts), np.int64, text.limit), space(len(counts), np.uint8, text.limit)
        self.since[:] = -1
        self.lows, self.last_key, self.last_at = _Lows(), -2, 0
        self.out = Sequence(text.limit)

    def before(self, key: np.ndarray, at: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(contexts filled, the character before each suffix, whether the suffix there is of the type sought)."""
        empty = np.flatnonzero((context == 1) & (at > 0))
        if len(empty):
            context = context.copy()
            context[empty] = self.text.context(at[empty].astype(np.int64))
        c = (context & self.text.mask).astype(self.text.key)
        if self.flip:
            c = (self.text.alphabet - 1 - c).astype(self.text.key)
        own, seed = key >> 1, key & 1
        return context, c, (context != 1) & ((c > own) | ((c == own) & (seed == 0)))

    def emit(self, key, at, context, prefix, c, gives, here: int) -> Columns:
        """Hand out suffixes in order and put in those before them; those of bucket ``here`` are given back instead."""
        if self.last_key % 2 == 0 or (key[:-1] & 1 < key[1:] & 1).any():
            former = np.concatenate([[self.last_key], key[:-1].astype(np.int64)])
            seam = np.flatnonzero((key & 1 == 1) & (former == key.astype(np.int64) - 1))
            if len(seam):
                left = np.where(seam > 0, at[seam - 1], self.last_at).astype(np.int64)
                prefix = prefix.copy()
                prefix[seam] = np.minimum(self.text.runs(left, int(self.width)), self.text.runs(at[seam].astype(np.int64), int(self.width)))
        own = key & 1 == 0
        done = (key >> 1, at, prefix) if self.flip else (key >> 1, at, context, prefix)  # only L suffixes are seeds again
        self.out.append(*(done if own.all() else (x[own] for x in done)))
        self.last_key, self.last_at = int(key[-1]), int(at[-1])
        i = np.flatnonzero(gives)
        if not len(i):
            self.lows.push(int(prefix.min()))
            return ()
        c = c[i]
        order = np.argsort(c, kind="stable")
        i, c = i[order], c[order]
        fresh = np.ones(len(i), bool)
        fresh[1:] = c[1:] != c[:-1]
        first, again = np.flatnonzero(fresh), np.flatnonzero(~fresh)
        common = np.empty(len(i), np.uint8)
        if len(again):
            common[again] = _range_least(prefix, i[again - 1] + 1, i[again])
        chars, i1 = c[first], i[first]
        since = self.since[chars]
        low = np.minimum(np.minimum(self.tail[chars], self.lows.since(since + 1)), np.minimum.accumulate(prefix)[i1])
        common[first] = low
        common = np.minimum(common, self.width - np.uint8(1)) + np.uint8(1)
        common[first[since < 0]] = 0
        last = i[np.append(first[1:], len(i)) - 1]
        rest = np.append(np.minimum.accumulate(prefix[::-1])[::-1], _FAR)
        self.tail[chars], self.since[chars] = rest[last + 1], self.lows.now
        self.lows.push(int(prefix.min()))
        bucket = self.bucket[c]
        near = int(np.searchsorted(bucket, here, side="right"))
        made = np.empty((len(i), 2), np.uint64)
        made[:, 0] = context[i] >> np.uint64(self.text.bits)
        made[:, 1] = common | (at[i] - self.text.position.type(1)).astype(np.uint64) << np.uint64(8) | (c - self.begin[bucket]).astype(np.uint64) << np.uint64(48)
        self.queue.put(bucket[near:], made[near:])
        return self.unpacked(here, made[:near]) if near else ()

    def unpacked(self, bucket: int, rows: np.ndarray) -> Columns:
        """(2 * character, position, context, common prefix) of a bucket's rows."""
        low = rows[:, 1]
        key = ((low >> np.uint64(48)) + np.uint64(self.begin[bucket])) << np.uint64(1)
        at = low >> np.uint64(8) & np.uint64((1 << 40) - 1)
        return key.astype(self.text.key), at.astype(self.text.position), rows[:, 0], low.astype(np.uint8)

    def run(self, seeds: Iterator[Columns]) -> Sequence:
        """``seeds`` are (character, position, context, common prefix) in order; the result is of that form too, without contexts in the second phase."""
        ready: list[Columns] = []

        def upto(end: int) -> Iterator[Columns]:
            while True:
                block = ready.pop() if ready else next(seeds, None)
                if block is None:
                    return
                stop = int(np.searchsorted(block[0], end))
                if stop < len(block[0]):
                    ready.append(tuple(x[stop:] for x in block))
                if stop:
                    yield (block[0][:stop] * self.text.key.type(2) + self.text.key.type(1), *[x[:stop] for x in block[1:]])
                if ready:
                    return

        def batches(columns: Columns) -> Iterator[Columns]:
            return (tuple(x[lo : lo + BATCH] for x in columns) for lo in range(0, len(columns[0]), BATCH))

        def hand_out(columns: Columns) -> None:
            for key, at, context, prefix in batches(columns):
                context, c, gives = self.before(key, at, context)
                self.emit(key, at, context, prefix, c, gives, -1)

        for k in range(len(self.begin) - 1):
            end = int(self.begin[k + 1])
            if end - self.begin[k] == 1:
                while self.queue.has(k):
                    for rows in self.queue.drain(k):
                        for lo in range(0, len(rows), BATCH):
                            hand_out(self.unpacked(k, rows[lo : lo + BATCH]))
                for columns in upto(end):
                    hand_out(columns)
            else:
                parts = [*(self.unpacked(k, rows) for rows in self.queue.drain(k)), *upto(end)]
                if parts:
                    self._merge(k, tuple(map(np.concatenate, zip(*parts))))
        return self.out

    def _merge(self, k: int, columns: Columns) -> None:
        """Work off a bucket of several characters: batches end before a key that something in them still precedes."""
        order = np.argsort(columns[0], kind="stable")
        key, at, context, prefix = (x[order] for x in columns)
        far = np.iinfo(self.text.key).max
        while len(key):
            n = min(len(key), BATCH)
            filled, c, gives = self.before(key[:n], at[:n], context[:n])
            near = np.where(gives & (self.bucket[np.where(gives, c, 0)] == k), c * self.text.key.type(2), far)
            over = np.flatnonzero(key[1:n] > np.minimum.accumulate(near)[:-1])
            stop = int(over[0]) + 1 if len(over) else n
            back = self.emit(key[:stop], at[:stop], filled[:stop], prefix[:stop], c[:stop], gives[:stop], k)
            key, at, context, prefix = key[stop:], at[stop:], context[stop:], prefix[stop:]
            if back and len(back[0]):
                key, at, context, prefix = (np.concatenate(x) for x in zip((key, at, context, prefix), back))
                order = np.argsort(key, kind="stable")
                key, at, context, prefix = key[order], at[order], context[order], prefix[order]


def _extended(text: _Text, star: np.ndarray, a: np.ndarray, b: np.ndarray, names: np.ndarray, width: int) -> np.ndarray:
    """Common prefixes of neighbouring stars: what equal names cover, and the characters behind it compared."""
    p, q = star[a].astype(np.int64), star[b].astype(np.int64)
    d = np.minimum(star[np.minimum(a + names, len(star) - 1)] - p, width)
    live = np.flatnonzero(d < width)
    while len(live):
        live = live[text.chars[p[live] + d[live]] == text.chars[q[live] + d[live]]]
        d[live] += 1
        live = live[d[live] < width]
    return d.astype(np.uint8)


def _doubled(chars: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for a short string, by doubling of compared prefixes in memory."""
    n = len(chars)
    _, rank = np.unique(chars, return_inverse=True)
    reach = 1
    while True:
        later = np.full(n, -1, np.int64)
        later[: n - reach] = rank[reach:]
        both = rank.astype(np.int64) * (n + 1) + later + 1
        order = np.argsort(both, kind="stable")
        new = np.ones(n, bool)
        new[1:] = both[order][1:] != both[order][:-1]
        rank[order] = np.cumsum(new) - 1
        if new.all():
            break
        reach *= 2
    common = np.zeros(n, np.uint8)
    live, text = np.arange(1, n), np.append(chars, chars[-1:])
    for d in range(width):
        live = live[text[order[live] + d] == text[order[live - 1] + d]]
        if not len(live):
            break
        common[live] += np.uint8(1)
    return order, common


def suffix_order(chars: np.ndarray, alphabet: int | None = None, width: int = 50, limit: int = LIMIT, short: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefixes) of non-negative integers whose last one is the unique least.

    The common prefix of a suffix is that with the one before it, cut at ``width`` (2 to 250).  Strings of
    at most ``short`` characters (a twelfth of the limit) end the recursion and are ordered in memory.
    """
    short = limit // 12 if short is None else short
    if 1 < len(chars) <= short:
        return _doubled(np.asarray(chars), width)
    text = _Text(chars, alphabet or int(chars.max()) + 1, limit)
    order, common = space(text.n, text.position, limit), space(text.n, np.uint8, limit)
    if text.n <= 1:
        return order, common
    star = text.stars()
    names, distinct = _names(text, star)
    if distinct == len(star):
        by_name, shared = space(len(star), text.position, limit), None
        for lo in range(0, len(star), BLOCK):
            by_name[names[lo : lo + BLOCK]] = np.arange(lo, min(len(star), lo + BLOCK))
    else:
        by_name, shared = suffix_order(names, distinct, width // 2 + 1, limit, short)
    del names

    def seeds() -> Iterator[Columns]:
        former = 0
        for lo in range(0, len(star), BATCH):
            i = by_name[lo : lo + BATCH].astype(np.int64)
            equal = shared[lo : lo + BATCH].astype(np.int64) if shared is not None else np.zeros(len(i), np.int64)
            common = np.zeros(len(i), np.uint8)
            begin = int(lo == 0)
            common[begin:] = _extended(text, star, np.concatenate([[former], i[:-1]])[begin:], i[begin:], equal[begin:], width)
            former = int(i[-1])
            at = star[i]
            yield text.chars[at].astype(text.key), at, text.context(at.astype(np.int64)), common

    counts = text.counts()
    large = _Induction(text, counts, False, width).run(seeds())

    def large_seeds() -> Iterator[Columns]:
        follows = np.zeros(1, np.uint8)
        for c, at, context, prefix in large.backwards():
            yield (text.alphabet - 1 - c).astype(text.key), at, context, np.concatenate([follows, prefix[:-1]])
            follows = prefix[-1:]

    small = _Induction(text, counts, True, width).run(large_seeds())
    # Of one character, L suffixes come before S suffixes.
    n_large = space(text.alphabet, np.int64, limit)
    for c, *_ in large:
        cuts = np.append(np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])), len(c))
        n_large[c[cuts[:-1]]] += np.diff(cuts)
    n_small = counts - n_large
    upto_large, below_small = np.cumsum(n_large), np.cumsum(n_small) - n_small
    done = 0
    for c, at, _, prefix in large:
        place = np.arange(done, done + len(c)) + below_small[c]
        order[place], common[place] = at, prefix
        done += len(c)
    done, order[0] = 1, text.n - 1  # the last suffix is the least and the first S suffix
    follows = np.zeros(1, np.uint8)
    for c, at, prefix in small.backwards():
        place = np.arange(done, done + len(c)) + upto_large[text.alphabet - 1 - c]
        order[place], common[place] = at, np.concatenate([follows, prefix[:-1]])
        follows, done = prefix[-1:], done + len(c)
    both = np.flatnonzero((n_large > 0) & (n_small > 0))
    for lo in range(0, len(both), BLOCK):
        place = (below_small + upto_large)[both[lo : lo + BLOCK]]
        common[place] = np.minimum(text.runs(order[place - 1].astype(np.int64), width), text.runs(order[place].astype(np.int64), width))
    return order, common


def equal_windows(text: np.ndarray, width: int, limit: int = LIMIT) -> Iterator[np.ndarray]:
    """Blocks of (position, whether it starts a class) over classes of equal windows of ``width`` characters.

    ``text`` holds characters from 2, ends of segments as 1 and a last 0.  Windows that reach over an end
    come too; they are never in a class with one that does not.
    """
    order, common = suffix_order(text, int(text.max()) + 1, width, limit)
    held: list[np.ndarray] = []
    flags: list[np.ndarray] = []
    for lo in range(0, len(order), BLOCK):
        at, new = np.asarray(order[lo : lo + BLOCK]), np.asarray(common[lo : lo + BLOCK]) < width
        last = int(np.flatnonzero(new)[-1]) if new.any() else -1
        if last >= 0:
            head = np.concatenate([*held, at[:last]]), np.concatenate([*flags, new[:last]])
            if len(head[0]):
                yield head
            held, flags = [at[last:]], [new[last:]]
        else:
            held.append(at)
            flags.append(new)
    if held:
        yield np.concatenate(held), np.concatenate(flags)
