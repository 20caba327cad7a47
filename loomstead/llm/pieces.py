"""Sampled SentencePiece segmentations: forward filtering and backward sampling over the piece lattice.

The lattice of a text holds every vocabulary piece that matches at a byte position, and byte pieces
where a character has no piece of its own.  Piece probabilities fall with the piece's rank in the
vocabulary (a Zipf law, as a merge vocabulary has ranks but no probabilities), raised to ``alpha``.
Forward filtering sums the weights of all segmentations of each prefix; backward sampling then draws
pieces from the end, each in proportion to its share, with numbers hashed from the row key and the
position.  So a row always gets the same segmentation, and every segmentation has its exact probability.

A word starts at the first space of each run of spaces and holds the whole run.  No piece crosses a word
start, so words are filtered apart and all words of a batch advance together, byte position by byte
position, in numpy.  A vocabulary with a piece that does cross one is refused.  A task keeps the lattices
of the words it has met, up to a bound past which it starts afresh; draws do not depend on what is kept.

Spaces are written as U+2581 with one added in front; an original U+2581 is spelled in byte pieces, so
decoding gives back every text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import by_size, tidy

#: Bytes of texts that are worked on at once.
BLOCK = 1 << 17
_WORD = re.compile(rb"(?<! ) ")
_BAR = "▁".encode()
_REST = re.compile(rb" ( *[^ ]*)")
_LOST = -1e30
#: Nodes of the word lattices that are kept from batch to batch.
STORE = 1 << 21
#: Bytes of a character, by its first byte; 1 for bytes that are none.
_CHAR = np.repeat(np.array([1, 2, 3, 4], np.int8), [192, 32, 16, 16])
#: Bits of a draw (the rest of 64 number a store's nodes), and of a piece id.
_FINE, _ID_BITS = 36, 24


class _Numbers(dict):
    """Words to numbers, counted up as new words are met."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class _Rows:
    """Equally long columns that grow at the end."""

    def __init__(self):
        self.n, self.columns = 0, []

    def add(self, *columns: np.ndarray) -> None:
        begin, self.n = self.n, self.n + len(columns[0])
        if not begin:  # no copy: one word may be very long
            self.columns = list(columns)
            return
        if self.n > len(self.columns[0]):
            for k, c in enumerate(self.columns):  # one by one, and without a touch of the pages still to fill
                self.columns[k] = np.empty(begin + self.n, c.dtype)
                self.columns[k][:begin] = c[:begin]
        for mine, more in zip(self.columns, columns):
            mine[begin : self.n] = more

    def __getitem__(self, k: int) -> np.ndarray:
        return self.columns[k][: self.n]


def _words(text: bytes) -> list[bytes]:
    """The words of a text with a space in front, each without its first space."""
    return _REST.findall(b" " + text) if b"  " in text or text.startswith(b" ") else text.split(b" ")


class PieceSampler:
    def __init__(self, model_path: str, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.byte_id = np.zeros(256, np.int32)
        pieces: dict[bytes, int] = {}
        self.spell: list[bytes] = [b""] * sp.get_piece_size()
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.spell[i] = bytes((int(p[3:5], 16),))
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if "▁" in p.lstrip("▁"):
                    raise ValueError(f"piece {p!r} crosses a word start")
                pieces[p.encode()] = i
                self.spell[i] = p.replace("▁", " ").encode()
        n = sp.get_piece_size()
        first = int(self.byte_id.max()) + 1
        rank = np.maximum(np.arange(n) - first, 0)
        self.weight = -alpha * np.log(rank + 2.7)
        self.weight[self.byte_id] = -alpha * np.log(2.0 * n)
        # A trie over bytes as one dense table; bytes that occur in no piece share a dead column.
        used = sorted({b for p in pieces for b in p})
        self.column = np.zeros(256, np.int64)
        self.column[used] = np.arange(1, len(used) + 1)
        kids: list[dict[int, int]] = [{}]
        ends = [-1]
        for p, i in pieces.items():
            at = 0
            for b in p:
                if b not in kids[at]:
                    kids[at][b] = len(kids)
                    kids.append({})
                    ends.append(-1)
                at = kids[at][b]
            ends[at] = i
        # 0, the root, stands for no way on; each worker has this table, so it is as narrow as its numbers allow.
        self.step = np.zeros((len(kids), len(used) + 1), np.uint16 if len(kids) <= 1 << 16 else np.int32)
        for at, k in enumerate(kids):
            for b, to in k.items():
                self.step[at, self.column[b]] = to
        self.ends = np.array(ends, np.int32)
        self.flat = self.step.ravel()
        self.alone = np.array([bytes((b,)) in pieces for b in range(256)])
        self.forget()

    def sample(self, texts: list[bytes], keys: np.ndarray, seed: int, bases: list[int] | None = None) -> list[np.ndarray]:
        """A segmentation of each text: piece ids, drawn by the text's key.

        A text with a base above 0 goes on from there in a longer one: it begins with the space of its
        first word, and none is put in front of it.
        """
        bases = bases or [0] * len(texts)
        words = [_words(t[1:] if base else t) for t, base in zip(texts, bases)]
        number = self._numbers(words)
        counts = np.array([len(w) for w in words])
        length = self.words[0].take(number)
        starts = np.cumsum(length) - length
        n = int(starts[-1] + length[-1])
        begin = starts[np.cumsum(counts) - counts]
        # Backward sampling for every word at once.
        own = _mix(keys.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) + np.array(bases, np.uint64) - begin.astype(np.uint64)
        live = np.argsort(number, kind="stable")  # equal words side by side, so that lookups stay near each other
        number, start, at = number.take(live), starts.take(live), length.take(live)
        key = (np.repeat(own, counts) + starts.astype(np.uint64)).take(live) * np.uint64(0xD1342543DE82EF95)
        node = self.words[1].take(number)
        cum, edge = self.edges[0], self.edges[1]
        out = np.full(n, -1, np.int32)
        while len(at):
            u = _mix(key + at.astype(np.uint64)) >> np.uint64(64 - _FINE)
            e = edge.take(np.searchsorted(cum, ((node + at).astype(np.uint64) << np.uint64(_FINE)) | u))
            at = e >> _ID_BITS
            out[start + at] = e & ((1 << _ID_BITS) - 1)
            on = np.flatnonzero(at)
            at, start, key, node = at.take(on), start.take(on), key.take(on), node.take(on)
        where = np.flatnonzero(out >= 0)
        return np.split(out.take(where), np.searchsorted(where, begin[1:]))

    def forget(self) -> None:
        """Drop the lattices that are kept."""
        self.number, self.nodes = _Numbers(), 0
        self.words, self.edges = _Rows(), _Rows()

    def _numbers(self, words: list[list[bytes]]) -> np.ndarray:
        """The store's number of each word, in order; lattices of new words are added to the store first."""
        flat = list(chain.from_iterable(words))
        number = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        new = self.number.new
        if self.nodes and self.nodes + sum(map(len, new)) + 4 * len(new) > STORE:
            self.forget()
            return self._numbers(words)
        if new:
            self._add(new)
            self.number.new = []
        return number

    def _add(self, words: list[bytes]) -> None:
        spelled = [(b" " + w).replace(b" ", _BAR) for w in words]
        text = b"\n".join(spelled) + b"\n"  # a byte for the end node of each word
        size = np.fromiter(map(len, spelled), np.int64, len(spelled)) + 1
        starts = np.cumsum(size) - size
        skip = []  # original bars
        for k in [k for k, w in enumerate(words) if _BAR in w]:
            at = int(starts[k])
            for between in (b" " + words[k]).split(_BAR)[:-1]:
                at += len(between.replace(b" ", _BAR))
                skip += range(at, at + 3)
                at += 3
        cum, edge = self._lattice(np.frombuffer(text, np.uint8), np.array(skip, np.int64), starts, size)
        self.words.add(size - 1, starts + self.nodes)
        self.edges.add(cum + (np.uint64(self.nodes) << np.uint64(_FINE)) if self.nodes else cum, edge)
        self.nodes += len(text)

    def _lattice(self, buf, skip, starts, size):
        """(cum, edge): the edges of the words by end node; a node is a byte of the buffer, each word's last one its end.

        ``cum`` is the end node's number and, in its low bits, the last draw that takes the edge; ``edge`` is
        the start's position in the word and the piece id.  ``skip`` are bytes that are spelled.
        """
        pos = np.arange(len(buf)) - np.repeat(starts, size)
        column = self.column.take(buf)
        column[skip] = column[starts + size - 1] = 0
        char = _CHAR.take(buf)
        whole = self.alone.take(buf)  # the bytes of a character without a piece are byte edges
        whole[starts + size - 1] = True
        edges_from, edges_to, edges_id = [], [], []
        alive = np.flatnonzero(column)
        state = np.zeros(len(alive), np.int64)
        wide = self.step.shape[1]
        depth = 0
        while len(alive):
            state = self.flat.take(state * wide + column.take(alive + depth))
            on = np.flatnonzero(state)
            alive, state = alive.take(on), state.take(on).astype(np.int64)
            depth += 1
            end = self.ends.take(state)
            hit = np.flatnonzero(end >= 0)
            met = alive.take(hit)
            edges_from.append(met)
            edges_to.append(met + depth)
            edges_id.append(end.take(hit))
            if 2 <= depth <= 4:
                whole[met.compress(char.take(met) == depth)] = True
        spelled = np.flatnonzero(~whole)
        if len(spelled):
            for k in range(1, 4):  # so are the bytes behind its first one
                lead = np.flatnonzero(whole & (char > k))
                whole[lead + k] = True
            spelled = np.flatnonzero(~whole)
            edges_from.append(spelled)
            edges_to.append(spelled + 1)
            edges_id.append(self.byte_id.take(buf.take(spelled)))
        a, z, i = map(np.concatenate, (edges_from, edges_to, edges_id))
        order = np.argsort(z.astype(np.uint16) if len(buf) <= 1 << 16 else z, kind="stable")  # 16 bits are sorted by radix
        a, z, i = a.take(order), z.take(order), i.take(order).astype(np.int64)
        # Forward filtering in step with the position in the word.
        place = pos.take(z)
        by_pos = np.argsort(place.astype(np.uint16) if size.max() <= 1 << 16 else place, kind="stable")
        start, end, w = a.take(by_pos), z.take(by_pos), self.weight.take(i.take(by_pos))
        head = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
        met, many = end.take(head), np.diff(np.concatenate([head, [len(end)]]))
        bounds = np.flatnonzero(np.diff(pos.take(met), prepend=-1, append=-1)).tolist()  # by nodes
        head_ = np.concatenate([head, [len(end)]])
        level = np.full(len(buf), _LOST)
        level[starts] = 0.0
        share, total = np.empty(len(z)), np.empty(len(head))
        for g0, g1 in zip(bounds, bounds[1:]):
            e0, e1 = head_[g0], head_[g1]
            cut, n = head[g0:g1] - e0, many[g0:g1]
            s = level.take(start[e0:e1])
            s += w[e0:e1]
            top = np.maximum.reduceat(s, cut)
            s -= np.repeat(top, n)
            np.exp(s, out=share[e0:e1])
            np.add.reduceat(share[e0:e1], cut, out=total[g0:g1])
            level[met[g0:g1]] = top + np.log(total[g0:g1])
        # Shares add up as whole numbers, so a draw does not depend on what else is in the lattice.
        part = np.empty(len(z), np.uint64)
        part[by_pos] = share / np.repeat(total, many) * 2.0**52
        run = np.cumsum(part)
        last = np.flatnonzero(np.concatenate([z[1:] != z[:-1], [True]]))
        run -= np.repeat(np.concatenate([[np.uint64(0)], run[last[:-1]]]), np.diff(last, prepend=-1))
        cum = np.minimum(run >> np.uint64(52 - _FINE), np.uint64(1 << _FINE))
        cum[last] = 1 << _FINE
        cum += (z.astype(np.uint64) << np.uint64(_FINE)) - np.uint64(1)
        return cum, pos.take(a) << _ID_BITS | i

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes: pieces joined, without the space that encoding put in front."""
        return b"".join(map(self.spell.__getitem__, ids.tolist()))[1:]


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


_SAMPLERS: dict[tuple, PieceSampler] = {}


def sampler(model_path: str, alpha: float) -> PieceSampler:
    """One sampler a Python worker."""
    if (model_path, alpha) not in _SAMPLERS:
        _SAMPLERS[model_path, alpha] = PieceSampler(model_path, alpha)
    return _SAMPLERS[model_path, alpha]


def text_blocks(text: bytes) -> list[tuple[int, bytes]]:
    """(base, part) of a long text, cut where a word starts; the base counts the bytes before it as they are spelled."""
    out, at, base = [], 0, 0
    while True:
        cut = _WORD.search(text, at + BLOCK) if len(text) - at > BLOCK else None
        part = text[at : cut.start()] if cut else text[at:]
        out.append((base, part))
        if not cut:
            return out
        base += len(part) + 2 * part.count(b" ") + 3 * (at == 0)
        at = cut.start()


def encode(docs: DataFrame, model_path: str, alpha: float = 1.0, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", copy_col: str | None = None, with_text: bool = False, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_pieces, pieces_crc32, lossless[, piece_ids][, decoded]) for each whole text.

    Null texts count as empty ones: the added space alone.  The row key is the id (null: 0) and the number of
    the copy, if there is such a column; without it repeated rows get equal segmentations.  ``lossless``
    says that decoding gave the text's bytes back.  Extra columns are ignored; an empty table gives no rows.
    Long texts are worked through in blocks of words; a stretch of text without a space is one lattice and
    takes about 320 times its bytes.
    """
    copy = F.col(copy_col).cast("long") if copy_col else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), copy.alias("copy"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    schema = "doc_id long, n_bytes long, n_pieces long, pieces_crc32 long, lossless boolean" + ", piece_ids array<int>" * with_ids + ", decoded binary" * with_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp = sampler(model_path, alpha)
        try:
            for b in batches:
                for rows_ in by_size([len(t) + 64 for t in b["t"]], BLOCK):
                    part = b.iloc[rows_]
                    texts = list(part["t"])
                    keys = part["doc_id"].fillna(0).to_numpy(np.int64) + (part["copy"].fillna(0).to_numpy(np.int64) << 40)
                    if len(texts) > 1 or len(texts[0]) <= BLOCK:
                        got = sp.sample(texts, keys, seed)
                    else:
                        got = [np.concatenate([sp.sample([t], keys, seed, [base])[0] for base, t in text_blocks(texts[0])])]
                    back = [sp.decode(g) for g in got]
                    out = {"doc_id": part["doc_id"].astype("Int64"), "n_bytes": [len(t) for t in texts], "n_pieces": [len(g) for g in got], "pieces_crc32": [zlib.crc32(g.astype("<u4").tobytes()) for g in got], "lossless": [x == t for x, t in zip(back, texts)]}
                    yield pd.DataFrame(out | ({"piece_ids": [g.astype(np.int32) for g in got]} if with_ids else {}) | ({"decoded": back} if with_text else {}))
        finally:
            sp.forget()  # an idle worker holds no lattices beside the next stage

    return rows.mapInPandas(tidy(run), schema)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "piece_ids") -> DataFrame:
    """The input with ``decoded``: the text's bytes from stored piece ids.  Null ids give null; an input column of that name is replaced."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sp = sampler(model_path, 1.0)
        for ids in batches:
            yield pd.Series([None if x is None else sp.decode(np.asarray(x)) for x in ids])

    return encoded.withColumn("decoded", run(F.col(ids_col)))
