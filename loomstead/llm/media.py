"""TIFF media columns: payloads stored as page images, and stored images read back page by page."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm import tiff
from loomstead.llm.common import by_size, tidy

UNIT = 64
#: Rows of 64 bytes that one page holds at most.
PAGE_ROWS = 1024


def encode_payload(text: bytes) -> bytes:
    """Bytes as grey pages 64 wide, zero-padded to a positive multiple of 64.

    The payload's checksum picks compression, strips or tiles, and predictor, so that equal texts are
    stored alike and every decoder is in use.  The first page's description holds the unpadded length.
    """
    padded = text + b"\0" * (-len(text) % UNIT) or b"\0" * UNIT
    rows = np.frombuffer(padded, np.uint8).reshape(-1, UNIT)
    pick = zlib.crc32(padded)
    codec = (tiff.PACKBITS, tiff.LZW, tiff.DEFLATE)[pick % 3]
    tiles = (UNIT, UNIT) if pick // 3 % 2 else None
    pages = [(rows[y : y + PAGE_ROWS], f"bytes={len(text)}" if y == 0 else "") for y in range(0, len(rows), PAGE_ROWS)]
    return tiff.write_pages(pages, codec, tiles, 1 + pick // 6 % 2)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): every whole text as a TIFF.

    Null texts are stored as empty ones, null ids stay null, repeated rows are stored each, extra columns are
    ignored, and an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rows_ in by_size([len(t) + 256 for t in b["t"]], 1 << 20):
                part = b.iloc[rows_]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "media": [encode_payload(t) for t in part["t"]]})

    return rows.mapInPandas(tidy(run), "doc_id long, media binary")


def pages(media: DataFrame, key_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page: key, page, width, height, samples, compression, predictor, description, pixels, mean, sd, error.

    A null cell gives no row.  A damaged or unknown file gives the pages before the damage, then a row with
    its error and null values.  Extra columns are ignored; repeated rows give their pages again.
    """
    rows = media.select(F.col(key_col).alias("key"), F.col(media_col).alias("media")).where("media is not null")
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, page int, width int, height int, samples int, compression int, predictor int, description string, pixels binary, mean double, sd double, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, data in zip(b["key"], b["media"]):
                n = 0
                try:
                    for n, p in enumerate(tiff.read_pages(bytes(data)), 1):
                        h, w, s = p.pixels.shape
                        out.append((key, n - 1, w, h, s, p.tags.get(tiff.COMPRESSION, (1,))[0], p.tags.get(tiff.PREDICTOR, (1,))[0], p.description, p.pixels.tobytes(), float(p.pixels.mean()), float(p.pixels.std()), None))
                except tiff.TiffError as e:
                    out.append((key, n, *[None] * 9, str(e)))
                if len(out) > 500:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    names = [c.split()[0] for c in schema.split(", ")]
    return rows.mapInPandas(tidy(run), schema)


def digests(media: DataFrame) -> DataFrame:
    """Per stored document, from the stored bytes alone: sizes, checksums and a feature string over its pages.

    Repeated rows give their row again; of grey levels equally frequent the darkest is the mode; an empty
    table gives no rows.  A file that ``store`` did not write is an error (``pages`` reads any).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, data in zip(b["doc_id"].astype(object), b["media"]):
                found = list(tiff.read_pages(data))
                payload = b"".join(p.pixels.tobytes() for p in found)
                counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                level = np.arange(256)
                mean = float((counts * level).sum() / counts.sum())
                sd = float((counts * (level - mean) ** 2).sum() / counts.sum()) ** 0.5
                feature = f"pages={len(found)};mean={mean:.4f};sd={sd:.4f};levels={int((counts > 0).sum())};mode={int(counts.argmax())}"
                length = int(found[0].description.removeprefix("bytes="))
                out.append((key, length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]).astype({"doc_id": "Int64"})

    return media.select("doc_id", "media").mapInPandas(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
