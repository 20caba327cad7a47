"""TIFF pages as rows: image directories, strips and tiles, PackBits, LZW and deflate, predictors.

The codec functions are plain Python and numpy; ``pages`` and ``store`` apply them to media columns.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format: tag numbers, field types and their sizes, compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CODECS = {"none": NONE, "lzw": LZW, "deflate": DEFLATE, "packbits": PACKBITS}
_CLEAR, _END = 256, 257
#: Bytes that one stored byte can stand for at most: a code of LZW or a symbol pair of deflate.
MOST_EXPANDED = 2800


class TiffError(ValueError):
    """The bytes are not a TIFF that this reader understands."""


_RUN = re.compile(rb"(.)\1{2,}", re.DOTALL)


def packbits_encode(data: bytes) -> bytes:
    out = bytearray()

    def literal(a: int, b: int) -> None:
        for k in range(a, b, 128):
            part = data[k : min(b, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    at = 0
    for m in _RUN.finditer(data):
        literal(at, m.start())
        left = m.end() - m.start()
        while left > 1:
            n = min(left, 128)
            out += bytes((257 - n, data[m.start()]))
            left -= n
        at = m.end() - left
    literal(at, len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size and at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


#: Codes between two clear codes, when the table fills up, and the width of each: the decoder's table then has 258, 258, 259, ... strings.
_SEGMENT = 3838
_WIDTHS = np.repeat([9, 10, 11, 12], [254, 512, 1024, _SEGMENT - 1790])
_OFFSETS = np.cumsum(_WIDTHS) - _WIDTHS


def _pack(segment: list[int]) -> np.ndarray:
    """A segment's codes as single bits, high bits first."""
    codes, widths = np.array(segment, ">u2"), _WIDTHS[: len(segment)]
    bits = np.unpackbits(codes.view(np.uint8)).reshape(-1, 16)
    return bits[np.arange(16) >= 16 - widths[:, None]]


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, widths growing one code early."""
    segments, codes = [np.array([1, 0, 0, 0, 0, 0, 0, 0, 0], np.uint8)], []
    table: dict[int, int] = {}
    get, put = table.get, codes.append
    nxt = 258
    if data:
        w = data[0]
        for b in data[1:]:
            k = w << 8 | b
            code = get(k)
            if code is None:
                put(w)
                table[k] = nxt
                nxt += 1
                w = b
                if nxt == 4095:
                    put(_CLEAR)
                    segments.append(_pack(codes))
                    codes.clear()
                    table.clear()
                    nxt = 258
            else:
                w = code
        put(w)
    put(_END)
    segments.append(_pack(codes))
    return np.packbits(np.concatenate(segments)).tobytes()


def _codes(bits: np.ndarray, at: int) -> np.ndarray:
    """The codes of one segment that starts at a bit."""
    n = int(np.searchsorted(_OFFSETS + _WIDTHS, len(bits) - at - 16, side="right"))
    spots = at + _OFFSETS[:n]
    return np.concatenate([bits[spots + 0][:, None], *[bits[spots + k][:, None] for k in range(1, 12)]], axis=1) @ _PLACES >> (12 - _WIDTHS[:n])


_PLACES = 1 << np.arange(11, -1, -1)
_BASE = [bytes((i,)) for i in range(256)] + [b"", b""]


def lzw_decode(data: bytes, size: int) -> bytes:
    bits = np.concatenate([np.unpackbits(np.frombuffer(data, np.uint8)), np.zeros(24, np.uint8)]).astype(np.int32)
    out, n_out, at = [], 0, 0
    while n_out < size:
        codes = _codes(bits, at).tolist()
        table, old = _BASE[:], b""
        grow, put = table.append, out.append
        used = len(codes)
        for i, code in enumerate(codes):
            if code < 256:
                entry = _BASE[code]
            elif code == _CLEAR:
                used = i
                break
            elif code == _END:
                return b"".join(out)
            elif code < len(table):
                entry = table[code]
            elif code == len(table) and old:
                entry = old + old[:1]
            else:
                raise TiffError("LZW code out of range")
            if old:
                grow(old + entry[:1])
            put(entry)
            old = entry
        else:
            if used == _SEGMENT:
                raise TiffError("LZW data lacks a clear code")
            return b"".join(out)
        n_out = sum(map(len, out)) if used else n_out
        at += int(_OFFSETS[used] + _WIDTHS[used])
    return b"".join(out)


def compress(data: bytes, codec: int) -> bytes:
    if codec == NONE:
        return data
    if codec == PACKBITS:
        return packbits_encode(data)
    if codec == LZW:
        return lzw_encode(data)
    if codec in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 6)
    raise TiffError(f"compression {codec} is not known")


def expand(data: bytes, codec: int, size: int) -> bytes:
    if codec == NONE:
        out = data
    elif codec == PACKBITS:
        out = packbits_decode(data, size)
    elif codec == LZW:
        out = lzw_decode(data, size)
    elif codec in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(str(e)) from e
    else:
        raise TiffError(f"compression {codec} is not known")
    if len(out) < size:
        raise TiffError("a strip or tile is too short")
    return out[:size]


@dataclass
class Page:
    """One image directory: its fields and its samples as rows x columns x samples."""

    tags: dict[int, tuple]
    pixels: np.ndarray = field(repr=False)

    @property
    def description(self) -> str:
        return b"".join(self.tags.get(DESCRIPTION, ())).rstrip(b"\0").decode("latin-1")


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    try:
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in FIELD:
                continue
            form = order + FIELD[kind] * count
            size = struct.calcsize(form)
            if size > len(data):
                raise TiffError("a field is longer than the file")
            where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            tags[tag] = struct.unpack_from(form, data, where)
        return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    except struct.error as e:
        raise TiffError("a directory points outside the file") from e


def _samples(raw: bytes, rows: int, cols: int, spp: int, bits: int, order: str, predictor: int) -> np.ndarray:
    kind = np.dtype({8: "u1", 16: order + "u2", 32: order + "u4"}[bits])
    a = np.frombuffer(raw, kind).reshape(rows, cols, spp)
    if predictor == 2:
        with np.errstate(over="ignore"):
            a = np.add.accumulate(a, axis=1, dtype=kind.newbyteorder("="))
    return a


def _page(data: bytes, tags: dict[int, tuple], order: str) -> np.ndarray:
    def number(tag: int, otherwise: int | None = None) -> int:
        value = tags[tag][0] if otherwise is None or tag in tags else otherwise
        if not isinstance(value, int) or value < 1:
            raise TiffError(f"field {tag} is no positive whole number")
        return value

    width, height, spp, bits = number(WIDTH), number(HEIGHT), number(SAMPLES, 1), number(BITS, 1)
    codec, predictor = number(COMPRESSION, NONE), number(PREDICTOR, 1)
    if bits not in (8, 16, 32) or predictor not in (1, 2) or len(set(tags.get(BITS, (bits,)))) > 1:
        raise TiffError("samples of this kind are not known")
    planes = spp if tags.get(PLANAR, (1,))[0] == 2 else 1
    each = spp // planes
    if TILE_WIDTH in tags:
        tw, th, offsets, counts = number(TILE_WIDTH), number(TILE_HEIGHT), tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        tw, th, offsets, counts = width, min(height, number(ROWS_PER_STRIP, height)), tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    across, down = -(-width // tw), -(-height // th)
    if len(offsets) != planes * across * down or len(counts) != len(offsets):
        raise TiffError("strips or tiles are missing")
    # A page holds no more than its strips and tiles can expand to, and a tile no more than its page twice over each way.
    if width * height * spp * bits // 8 > MOST_EXPANDED * (len(data) + 64) or tw * th * each * bits // 8 > MOST_EXPANDED * (len(data) + 64):
        raise TiffError("a page is larger than its data can be")
    pixels = np.zeros((height, width, spp), np.dtype(f"u{bits // 8}"))
    for k, (o, c) in enumerate(zip(offsets, counts)):
        plane, k = divmod(k, across * down)
        y, x = (k // across) * th, (k % across) * tw
        rows = th if TILE_WIDTH in tags else min(th, height - y)
        raw = expand(data[o : o + c], codec, rows * tw * each * bits // 8)
        block = _samples(raw, rows, tw, each, bits, order, predictor)
        h, w = min(rows, height - y), min(tw, width - x)
        pixels[y : y + h, x : x + w, plane * each : plane * each + each] = block[:h, :w]
    return pixels


def read_pages(data: bytes) -> Iterator[Page]:
    """Walk the chain of image directories and decode each page; a loop in the chain is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at:
        if at in seen:
            raise TiffError("the directories form a loop")
        seen.add(at)
        tags, at = _directory(data, at, order)
        try:
            pixels = _page(data, tags, order)
        except (KeyError, IndexError) as e:
            raise TiffError(f"a page lacks field {e}") from e
        except (ValueError, TypeError, ArithmeticError, MemoryError, struct.error) as e:
            raise e if isinstance(e, TiffError) else TiffError(f"a page cannot be read: {e}") from e
        yield Page(tags, pixels)


def write_pages(pages: list[tuple[np.ndarray, str]], codec: int = DEFLATE, tiles: tuple[int, int] | None = None, predictor: int = 1, rows_per_strip: int = 128) -> bytes:
    """A little-endian TIFF of 8-bit grey pages (rows x columns), in strips, or in tiles of (width, height)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for pixels, description in pages:
        height, width = pixels.shape
        blocks = []
        if tiles:
            tw, th = tiles
            padded = np.zeros((-(-height // th) * th, -(-width // tw) * tw), np.uint8)
            padded[:height, :width] = pixels
            blocks = [padded[y : y + th, x : x + tw] for y in range(0, height, th) for x in range(0, width, tw)]
        else:
            blocks = [pixels[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, counts = [], []
        for b in blocks:
            if predictor == 2:
                b = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], axis=1)
            raw = compress(b.tobytes(), codec)
            offsets.append(len(out))
            counts.append(len(raw))
            out += raw + b"\0" * (len(raw) % 2)
        text = description.encode("latin-1") + b"\0"
        fields = [(WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (8,)), (COMPRESSION, 3, (codec,)), (PHOTOMETRIC, 3, (1,)), (DESCRIPTION, 2, text)]
        fields += [(SAMPLES, 3, (1,)), (PREDICTOR, 3, (predictor,))]
        fields += [(TILE_WIDTH, 4, (tiles[0],)), (TILE_HEIGHT, 4, (tiles[1],)), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tiles else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, (rows_per_strip,)), (STRIP_COUNTS, 4, counts)]
        entries = b""
        for tag, kind, values in sorted(fields, key=lambda f: f[0]):
            raw = bytes(values) if kind == 2 else struct.pack("<" + FIELD[kind] * len(values), *values)
            if len(raw) > 4:
                where = struct.pack("<I", len(out))
                out += raw + b"\0" * (len(raw) % 2)
            else:
                where = raw.ljust(4, b"\0")
            entries += struct.pack("<HHI", tag, kind, len(values)) + where
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)
