"""Media columns: TIFF files to one row a page, and texts stored as such files.

The reader walks the chain of image directories in either byte order, takes strips or tiles, decodes
none, PackBits, LZW or deflate, undoes horizontal differencing, and gives samples row by row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import map_batches, small, text_or_empty

NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
_WIDTH, _LENGTH, _BITS, _COMPRESSION, _PHOTOMETRIC, _STRIPS, _SAMPLES, _ROWS, _STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
_PLANAR, _PREDICTOR, _TILE_WIDTH, _TILE_LENGTH, _TILES, _TILE_BYTES = 284, 317, 322, 323, 324, 325
_KINDS = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 16: "Q"}
#: Samples of one row in the images that hold texts.
ROW_BYTES = 64


@dataclass
class Page:
    width: int
    height: int
    bits: int
    samples: int
    compression: int
    predictor: int
    data: bytes


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while i + run < n and run < 128 and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        start = i
        while i < n and i - start < 128 and not (i + 2 < n and data[i] == data[i + 1] == data[i + 2]):
            i += 1
        out.append(i - start - 1)
        out += data[start:i]
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears, 257 ends; the width grows one code early."""
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    words, width, last, out = list(base), 9, None, []
    held, bits = 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            words, width, last = list(base), 9, None
            continue
        if last is None:
            word = words[code]
        else:
            if code > len(words):
                raise ValueError("a code of this LZW stream is out of range")
            word = words[code] if code < len(words) else last + last[:1]
            words.append(last + word[:1])
            width = 12 if len(words) >= 2047 else 11 if len(words) >= 1023 else 10 if len(words) >= 511 else 9
        out.append(word)
        last = word
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    known, width = {bytes((i,)): i for i in range(256)}, 9
    held, bits, size, word, out = 256, 9, 258, b"", bytearray()

    def flush() -> None:
        nonlocal held, bits
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        flush()

    flush()
    for value in data:
        longer = word + bytes((value,))
        if longer in known:
            word = longer
            continue
        put(known[word])
        known[longer] = size
        size += 1
        width = 12 if size > 2047 else 11 if size > 1023 else 10 if size > 511 else 9
        word = longer[-1:]
        if size == 4094:
            put(256)
            known, width, size = {bytes((i,)): i for i in range(256)}, 9, 258
    if word:
        put(known[word])
        size += 1
        width = 12 if size > 2047 else 11 if size > 1023 else 10 if size > 511 else 9
    put(257)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def _difference(rows: np.ndarray, samples: int) -> np.ndarray:
    out = rows.copy()
    out[:, samples:] -= rows[:, :-samples]
    return out


def _undo(rows: np.ndarray, samples: int) -> np.ndarray:
    shape = rows.shape
    return np.cumsum(rows.reshape(shape[0], -1, samples), axis=1, dtype=rows.dtype).reshape(shape)


def encode_page(
    payload: bytes, width: int, compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 1024, tile: tuple[int, int] | None = None, order: str = "<"
) -> bytes:
    """One 8-bit grey page of whole rows as a TIFF file; tile: (width, height), multiples of 16."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, width)
    height = len(pixels)
    pack = {NONE: bytes, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_bits, LZW: lzw_encode}[compression]
    blocks = []
    if tile:
        tw, th = tile
        for y in range(0, height, th):
            for x in range(0, width, tw):
                block = np.zeros((th, tw), np.uint8)
                part = pixels[y : y + th, x : x + tw]
                block[: part.shape[0], : part.shape[1]] = part
                blocks.append(block)
    else:
        blocks = [pixels[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
    packed = [pack((_difference(b, 1) if predictor == 2 else b).tobytes()) for b in blocks]
    offsets, at = [], 8
    for b in packed:
        offsets.append(at)
        at += len(b) + len(b) % 2
    tags = [(_WIDTH, 4, [width]), (_LENGTH, 4, [height]), (_BITS, 3, [8]), (_COMPRESSION, 3, [compression]), (_PHOTOMETRIC, 3, [1]), (_SAMPLES, 3, [1]), (_PREDICTOR, 3, [predictor])]
    if tile:
        tags += [(_TILE_WIDTH, 4, [tile[0]]), (_TILE_LENGTH, 4, [tile[1]]), (_TILES, 4, offsets), (_TILE_BYTES, 4, [len(b) for b in packed])]
    else:
        tags += [(_STRIPS, 4, offsets), (_ROWS, 4, [rows_per_strip]), (_STRIP_BYTES, 4, [len(b) for b in packed])]
    tags.sort()
    directory, extra, far = struct.pack(order + "H", len(tags)), b"", at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        raw = struct.pack(f"{order}{len(values)}{_KINDS[kind]}", *values)
        if len(raw) > 4:
            directory += struct.pack(order + "HHII", tag, kind, len(values), far + len(extra))
            extra += raw
        else:
            directory += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    body = b"".join(b + b"\0" * (len(b) % 2) for b in packed)
    return struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, at) + body + directory + struct.pack(order + "I", 0) + extra


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple[int, ...]]]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("this is no TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the chain of image directories loops")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in _KINDS:
                form = f"{order}{count}{_KINDS[kind]}"
                where = at + 10 + 12 * i
                if struct.calcsize(form) > 4:
                    (where,) = struct.unpack_from(order + "I", data, where)
                tags[tag] = struct.unpack_from(form, data, where)
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages in the order of their directories; samples of over 8 bits come in the file's byte order."""
    for order, tags in _directories(data):
        one = lambda tag, default: tags.get(tag, (default,))[0]
        width, height, samples, predictor, kind = one(_WIDTH, 0), one(_LENGTH, 0), one(_SAMPLES, 1), one(_PREDICTOR, 1), one(_COMPRESSION, 1)
        bits = one(_BITS, 1)
        if one(_PLANAR, 1) != 1 or predictor not in (1, 2) or predictor == 2 and bits not in (8, 16, 32):
            raise ValueError("planar samples and this predictor are not supported")
        decode = {NONE: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}.get(kind)
        if decode is None:
            raise ValueError(f"compression {kind} is not supported")
        tiled = _TILES in tags
        bw, bh = (one(_TILE_WIDTH, 0), one(_TILE_LENGTH, 0)) if tiled else (width, min(one(_ROWS, height), height))
        offsets, counts = (tags[_TILES], tags[_TILE_BYTES]) if tiled else (tags[_STRIPS], tags[_STRIP_BYTES])
        row_bytes, block_row = (width * samples * bits + 7) // 8, (bw * samples * bits + 7) // 8
        page = np.zeros((height, row_bytes), np.uint8)
        across = -(-width // bw) if bw else 1
        for k, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
            y, x = k // across * bh, k % across * block_row
            high = bh if tiled else min(bh, height - y)
            raw = np.frombuffer(decode(data[offset : offset + count]), np.uint8)[: high * block_row].reshape(high, block_row)
            if predictor == 2:
                typed = raw.view(np.dtype(f"{order}u{bits // 8}")) if bits > 8 else raw
                raw = _undo(typed, samples).view(np.uint8)
            part = raw[: height - y, : row_bytes - x]
            page[y : y + part.shape[0], x : x + part.shape[1]] = part
        yield Page(width, height, bits, samples, kind, predictor, page.tobytes())


def _pad(raw: bytes) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES, b"\0")


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", compression: int = DEFLATE, predictor: int = 2) -> DataFrame:
    """id, n_bytes, media: each whole text as one page of 64 samples a row, padded with zero bytes to full rows.

    Null counts as the empty text, which gives one row of zeros. Equal texts give equal files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            raw = [t.encode() for t in batch.column(1).to_pylist()]
            media = [encode_page(_pad(b), ROW_BYTES, compression, predictor) for b in raw]
            yield pa.record_batch([batch.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], ["__id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col).alias("__id"), text_or_empty(text_col)), run, f"__id {kind}, n_bytes long, media binary").withColumnRenamed("__id", id_col)


PAGE_FIELDS = "page int, width int, height int, bits int, samples int, compression int, predictor int, pixels binary, mean_milli long, distinct_values int, error string"


def tiff_pages(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a page: the kept columns, the page's geometry and its samples, mean and number of values.

    Null media give no row. A file that can't be read gives one row with page null and error set, so that
    one bad file stops nothing. Columns of the input named like a result are not kept.
    """
    names = [n.split()[0] for n in PAGE_FIELDS.split(", ")]
    keep = tuple(k for k in keep if k not in names)
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows, source = [], []
            for i, data in enumerate(batch.column(len(keep)).to_pylist()):
                if data is None:
                    continue
                try:
                    found = []
                    for n, p in enumerate(read_pages(data)):
                        values = np.bincount(np.frombuffer(p.data, np.uint8), minlength=256)
                        total = int(values @ np.arange(256))
                        found.append((n, p.width, p.height, p.bits, p.samples, p.compression, p.predictor, p.data, 1000 * total // max(1, len(p.data)), int((values > 0).sum()), None))
                except Exception as e:  # noqa: BLE001  whatever a broken file raises becomes its row's error
                    found = [(None,) * 10 + (f"{type(e).__name__}: {e}"[:200],)]
                rows += found
                source += [i] * len(found)
            kept = [batch.column(j).take(pa.array(source, pa.int64())) for j in range(len(keep))]
            types = [pa.int32()] * 7 + [pa.binary(), pa.int64(), pa.int32(), pa.string()]
            cols = [pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]
            yield pa.record_batch(kept + cols, [*keep, *names])

    return map_batches(df.select(*keep, media_col), run, f"{kinds}, {PAGE_FIELDS}" if kinds else PAGE_FIELDS)
