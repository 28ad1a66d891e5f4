"""Media columns: byte payloads stored as lossless WebP tiles, and read back as pixel arrays.

A payload is the samples of RGB pixels in rows of 64. Rows are cut into tiles of at most 64 by 64 pixels, each a
complete WebP file; a media value is its tiles in a row, so it is never larger than memory allows at once and its tiles
are decoded together.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .common import documents

WIDTH = 64
ROW = 3 * WIDTH
TILE = ROW * 64
#: A tile of so many pixels at least repeats itself if a colour occurs so many times, on the mean.
PEEK, REPEATS = 256, 4
#: Bytes of payloads that are coded together.
TOGETHER = 6_000_000


def payload(data: bytes) -> bytes:
    """data and spaces up to a positive multiple of a row."""
    return data + b" " * ((-len(data)) % ROW or (0 if data else ROW))


def store(payloads: list[bytes]) -> list[bytes]:
    """The media value of each payload (a positive multiple of ROW long)."""
    tiles = [[p[a : a + TILE] for a in range(0, len(p), TILE)] for p in payloads]
    every = [t for x in tiles for t in x]
    files = [tight(t) for t in every]
    literal = iter(webp.encode_literals([t for t, f in zip(every, files, strict=True) if f is None], WIDTH))
    done = iter([next(literal) if f is None else f for f in files])
    return [b"".join(next(done) for _ in x) for x in tiles]


#: n log2 n of each count in a tile, and what tells the channels' samples apart.
_WEIGHTS = np.arange(TILE // 3 + 1) * np.log2(np.maximum(1, np.arange(TILE // 3 + 1)))
_CHANNELS = np.arange(3, dtype=np.int64) * 256


def _entropy(channels: np.ndarray) -> float:
    """Bits that samples (pixels, 3) of a tile take by their channels' own counts, about."""
    n = np.bincount((channels + _CHANNELS).ravel(), minlength=3 * 256)
    return float(3 * _WEIGHTS[len(channels)] - _WEIGHTS[n].sum())


def transforms(rgb: np.ndarray) -> dict:
    """Transforms that make the samples (pixels, 3) of a tile cheaper: a predictor from the left or from above, or colours
    as differences to green; the cheapest if it saves a tenth at least."""
    left, above = (np.concatenate([rgb[-k:], rgb[:-k]]) for k in (1, WIDTH))
    green = rgb - rgb[:, 1:2] * np.array([1, 0, 1], np.uint8)
    ways = [(_entropy(rgb - left), {"predictor": 1}), (_entropy(rgb - above), {"predictor": 2}), (_entropy(green), {"cross": (32, 32, 0)})]
    bits, best = min(ways, key=lambda x: x[0])
    return best if bits < 0.9 * _entropy(rgb) else {}


def tight(tile: bytes) -> bytes | None:
    """The file of a tile whose pixels repeat or follow their neighbours: a palette, or a colour cache if its pixels are
    too many for one, or the transform that its samples' entropy asks for, and back-references. Nothing for another
    tile, whose literals take less work and no more room. All of a tile's pixels decide."""
    if len(tile) < 3 * PEEK:
        return None
    rgb = np.frombuffer(tile, np.uint8).reshape(-1, 3)
    x = rgb.astype(np.uint32)
    pixels = x[:, 0] << 16 | x[:, 1] << 8 | x[:, 2] | 0xFF000000
    ranked = np.sort(pixels)
    colours = 1 + int(np.count_nonzero(ranked[1:] != ranked[:-1]))
    repeats = colours * REPEATS <= len(pixels)
    how = {} if colours <= 256 and repeats else transforms(rgb)
    if not repeats and not how:
        return None
    few = colours <= 256 and not how
    return webp.file_of(webp.encode(pixels.reshape(-1, WIDTH), palette=few, cached=0 if few else 6, matches=True, **how))


def load(media: list[bytes]) -> list[np.ndarray]:
    """Samples (rows, WIDTH, 3) of each media value, of whatever lossless WebP files it consists."""
    streams, counts = [], []
    for m in media:
        at, n = 0, len(streams)
        while at < len(m):
            stream, at = webp.stream_of(m, at)
            streams.append(stream)
        counts.append(len(streams) - n)
    images = iter(webp.decode_many(streams))
    out = []
    for n in counts:
        parts = [next(images) for _ in range(n)]
        pixels = np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.uint32)
        out.append(np.ascontiguousarray(pixels).view(np.uint8).reshape(*pixels.shape, 4)[..., 2::-1])
    return out


def feature(samples: np.ndarray) -> str:
    """Rows, mean of each channel in thousandths, distinct values, and steps between neighbours (sum of absolute differences)."""
    flat = samples.reshape(-1, 3)
    n = max(1, len(flat))
    mean = [int(x) * 1000 // n for x in flat.sum(axis=0, dtype=np.int64)]
    green = flat[:, 1].astype(np.int16)
    used = int(np.count_nonzero(np.bincount(flat.ravel(), minlength=256)))
    return f"rows={len(samples)};mean={','.join(map(str, mean))};values={used};steps={int(np.abs(np.diff(green)).sum())}"


OUT = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """A row for each row of docs: its id and what its stored payload gives when read back; with_media: the value too.

    Null text: as the empty one, whose payload is one row of spaces. Repeated rows and null ids: like others. No rows: no rows.
    """
    rows = docs.select(F.col(id_col).alias("md_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("md_data"))
    kind = rows.schema["md_id"].dataType.simpleString()
    names = [id_col, *[c.split()[0] for c in OUT.split(", ")], *["media"] * with_media]

    def work(ids, data):
        stored = store([payload(x) for x in data])
        read = load(stored)
        cols: list[list] = [[] for _ in range(7)]
        for x, media, samples in zip(data, stored, read, strict=True):
            back = samples.tobytes()
            for c, v in zip(cols, (len(x), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], *[pa.array(stored, pa.binary())] * with_media], names)

    def run(batches):
        for batch in batches:
            data, begin, total = batch.column(1).to_pylist(), 0, 0
            for i, x in enumerate(data):
                total += len(x)
                if total >= TOGETHER or i + 1 == len(data):
                    yield work(batch.column(0).slice(begin, i + 1 - begin), data[begin : i + 1])
                    begin, total = i + 1, 0

    return rows.mapInArrow(run, f"`{id_col}` {kind}, {OUT}{', media binary' if with_media else ''}")


def op2_media(spark, sf_dir: str) -> DataFrame:
    return media_column(documents(spark, sf_dir))
