"""TIFF media columns: a binary column of TIFF files in, one row per page out.

The reader walks the chain of image directories, gathers the strips or tiles of
each page, expands PackBits, LZW or deflate, undoes the horizontal predictor and
gives the page's samples. It takes 8-bit samples, chunky layout, either byte
order. The writer stores bytes as pages of 192 x 64 RGB pixels (576 bytes a
row): single rows as LZW, other pages in turn as deflate tiles with predictor
and PackBits strips.

Cases: a null or malformed file, or a predictor or compression it does not
know, gives a last page row that holds only ``error``; a
chain of directories that comes back to itself ends with an error; null text
counts as empty; rows are independent, so repeated rows agree; an empty table
gives an empty result; other columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, prepare, session, utf8_list

# Fixed values of the TIFF format: tags, compression schemes and field sizes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PREDICTOR = 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD = {1: "B", 3: "H", 4: "I"}
#: Samples that a stored byte gives at most: a pair of bytes, 128; deflate's bound; an LZW code of over a byte, a string of the 12-bit table.
EXPANDS = {PLAIN: 1, PACKBITS: 64, DEFLATE: 1032, OLD_DEFLATE: 1032, LZW: 4096}

UNIT, PAGE_ROWS, PAGE_WIDTH, CHANNELS = 576, 64, 192, 3
TILE = (96, 16)  # width and height in pixels

PAGE = "struct<page: int, width: int, height: int, samples: int, compression: int, pixels: binary, feature: string, error: string>"
PAGE_ARROW = pa.list_(
    pa.struct([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("compression", pa.int32()), ("pixels", pa.binary()), ("feature", pa.string()), ("error", pa.string())])
)


def packbits(row: bytes) -> bytes:
    """PackBits of one row: runs of three or more, literals between them."""
    out, at = [], 0
    for m in [*re.finditer(rb"(.)\1{2,127}", row, re.DOTALL), None]:
        end = m.start() if m else len(row)
        for a in range(at, end, 128):
            part = row[a : min(a + 128, end)]
            out += [bytes([len(part) - 1]), part]
        if m:
            out += [bytes([257 - len(m[0])]), m[1]]
            at = m.end()
    return b"".join(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at, n = [], 0, 0
    while n < size and at < len(data):
        c = data[at]
        if c < 128:
            part = data[at + 1 : at + 2 + c]
            at += 2 + c
        elif c > 128:
            part = data[at + 1 : at + 2] * (257 - c)
            at += 2
        else:
            part, at = b"", at + 1
        out.append(part)
        n += len(part)
    return b"".join(out)[:size]


def lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, highest bit first; the width grows one code early."""
    table = {bytes([i]): i for i in range(256)}
    bits, n_bits, width, prefix, code = 256, 9, 9, b"", 258
    for i in range(len(data)):
        longer = data[i : i + 1] if not prefix else prefix + data[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        bits, n_bits = bits << width | table[prefix], n_bits + width
        table[longer] = code
        code += 1
        if code == 4094:
            bits, n_bits, width, code = bits << 12 | 256, n_bits + 12, 9, 258
            table = {bytes([i]): i for i in range(256)}
        elif code + 1 > 1 << width:
            width += 1
        prefix = data[i : i + 1]
    if prefix:
        bits, n_bits = bits << width | table[prefix], n_bits + width
        code += 1
        if code + 1 > 1 << width and width < 12:
            width += 1
    bits, n_bits = bits << width | 257, n_bits + width
    return (bits << (-n_bits % 8)).to_bytes((n_bits + 7) // 8, "big")


def unlzw(data: bytes, size: int) -> bytes:
    bits, n_bits = int.from_bytes(data, "big"), 8 * len(data)
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, last, out, n = list(base), 9, b"", [], 0
    at = n_bits
    while at >= width and n < size:
        at -= width
        code = bits >> at & ((1 << width) - 1) if n_bits < 8192 else int.from_bytes(data[(n_bits - at - width) // 8 : (n_bits - at - width) // 8 + 4].ljust(4, b"\0"), "big") >> (32 - width - (n_bits - at - width) % 8) & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out.append(entry)
        n += len(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)[:size]


def expand(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == PLAIN:
        out = data[:size]
    elif scheme in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    elif scheme == PACKBITS:
        out = unpackbits(data, size)
    else:
        out = unlzw(data, size)
    if len(out) < size:
        raise ValueError("strip or tile too short")
    return out


def feature(pixels: np.ndarray, width: int, height: int, samples: int) -> str:
    """Shape, mean and entropy (bits) of a page's samples."""
    counts = np.bincount(pixels, minlength=256)
    share = counts[counts > 0] / max(1, len(pixels))
    mean = float(counts @ np.arange(256)) / max(1, len(pixels))
    return f"{width}x{height}x{samples}:{mean:.3f}:{float(-(share * np.log2(share)).sum()) + 0.0:.3f}"


def read_directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    """The integer fields of the directory at a place, and where the next one is."""
    (n,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind in FIELD:
            form = f"{order}{count}{FIELD[kind]}"
            place = at + 10 + 12 * i
            if struct.calcsize(form) > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            if place + struct.calcsize(form) > len(data):
                raise ValueError("field outside the file")
            fields[tag] = list(struct.unpack_from(form, data, place))
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def read_page(data: bytes, fields: dict[int, list[int]]) -> dict:
    one = lambda tag, default=None: fields[tag][0] if tag in fields or default is None else default
    width, height, samples, scheme = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(COMPRESSION, PLAIN)
    if set(fields.get(BITS, [1])) != {8} or fields.get(284, [1]) != [1]:
        raise ValueError("only 8-bit chunky samples")
    if min(width, height, samples) < 1:
        raise ValueError("a page without pixels")
    if TILE_WIDTH in fields:
        wide, high, offsets, sizes = one(TILE_WIDTH), one(TILE_HEIGHT), fields[TILE_OFFSETS], fields[TILE_BYTES]
    else:
        wide, high, offsets, sizes = width, min(height, one(ROWS_PER_STRIP, height)), fields[STRIP_OFFSETS], fields[STRIP_BYTES]
    if min(wide, high) < 1:
        raise ValueError("strips or tiles without pixels")
    across, down = -(-width // wide), -(-height // high)
    if min(len(offsets), len(sizes)) < across * down:
        raise ValueError("strips or tiles are missing")
    predictor = one(PREDICTOR, 1)
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor}")
    if scheme not in EXPANDS:
        raise ValueError(f"compression {scheme}")
    rows_of = lambda y: high if TILE_WIDTH in fields else min(high, height - y)  # the last strip may be shorter
    for i, (place, size) in enumerate(zip(offsets[: across * down], sizes)):
        if rows_of(i // across * high) * wide * samples > EXPANDS[scheme] * max(0, min(size, len(data) - place)):
            raise ValueError("strip or tile too short")
    page = np.empty((down * high, across * wide, samples), np.uint8)
    for i, (place, size) in enumerate(zip(offsets[: across * down], sizes)):
        y, x = i // across * high, i % across * wide
        rows = rows_of(y)
        block = np.frombuffer(expand(data[place : place + size], scheme, rows * wide * samples), np.uint8).reshape(rows, wide, samples)
        if predictor == 2:
            block = np.add.accumulate(block, axis=1, dtype=np.uint8)
        page[y : y + rows, x : x + wide] = block
    pixels = np.ascontiguousarray(page[:height, :width]).ravel()
    return {"width": width, "height": height, "samples": samples, "compression": scheme, "pixels": pixels.tobytes(), "feature": feature(pixels, width, height, samples)}


def read_pages(data: bytes | None) -> list[dict]:
    """All pages of a TIFF file; a last entry with ``error`` where reading had to stop."""
    pages: list[dict] = []
    try:
        order = {b"II": "<", b"MM": ">"}[data[:2]]
        mark, at = struct.unpack_from(order + "HI", data, 2)
        if mark != 42:
            raise ValueError("not a TIFF file")
        seen = set()
        while at:
            if at in seen:
                raise ValueError("directories form a circle")
            seen.add(at)
            fields, at = read_directory(data, at, order)
            pages.append(read_page(data, fields) | {"page": len(pages)})
    except (TypeError, KeyError, ValueError, struct.error, zlib.error, IndexError) as e:
        pages.append({"page": len(pages), "error": f"{type(e).__name__}: {e}"})
    return pages


def page_blocks(rows: np.ndarray, scheme: int, tiled: bool) -> list[bytes]:
    """rows: (height, width, channels). The page's compressed strips or tiles."""
    if tiled:
        wide, high = TILE
        out = []
        for y in range(0, len(rows), high):
            for x in range(0, rows.shape[1], wide):
                tile = np.zeros((high, wide, rows.shape[2]), np.uint8)
                part = rows[y : y + high, x : x + wide]
                tile[: part.shape[0], : part.shape[1]] = part
                tile[:, 1:] -= tile[:, :-1].copy()
                out.append(zlib.compress(tile.tobytes(), 1))
        return out
    if scheme == LZW:
        return [lzw(rows.tobytes())]
    return [b"".join(packbits(r.tobytes()) for r in rows[y : y + 8]) for y in range(0, len(rows), 8)]


def write_tiff(payload: bytes) -> bytes:
    """A TIFF file whose pages hold the payload, a positive multiple of 576 bytes."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, PAGE_WIDTH, CHANNELS)
    body, link = bytearray(b"II*\0\0\0\0\0"), 4
    for number, y in enumerate(range(0, len(image), PAGE_ROWS)):
        rows = image[y : y + PAGE_ROWS]
        tiled = len(rows) > 1 and number % 2 == 0
        scheme = LZW if len(rows) == 1 else DEFLATE if tiled else PACKBITS
        offsets, sizes = [], []
        for block in page_blocks(rows, scheme, tiled):
            offsets.append(len(body))
            sizes.append(len(block))
            body += block
        fields = {WIDTH: [PAGE_WIDTH], HEIGHT: [len(rows)], BITS: [8] * CHANNELS, COMPRESSION: [scheme], PHOTOMETRIC: [2], SAMPLES: [CHANNELS]}
        if tiled:
            fields |= {PREDICTOR: [2], TILE_WIDTH: [TILE[0]], TILE_HEIGHT: [TILE[1]], TILE_OFFSETS: offsets, TILE_BYTES: sizes}
        else:
            fields |= {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [len(rows) if scheme == LZW else 8], STRIP_BYTES: sizes}
        entries = []
        for tag, values in sorted(fields.items()):
            packed = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                place = len(body)
                body += packed
                packed = struct.pack("<I", place)
            entries.append(struct.pack("<HHI", tag, 4, len(values)) + packed)
        body += b"\0" * (len(body) % 2)
        struct.pack_into("<I", body, link, len(body))
        body += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(body)
        body += b"\0\0\0\0"
    return bytes(body)


def padded(text: bytes, unit: int = UNIT) -> bytes:
    """The bytes with 255 appended up to a positive multiple of the unit."""
    return text + b"\xff" * (max(1, -(-len(text) // unit)) * unit - len(text))


def _declared(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])


def store_texts(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep``, n_bytes and media (a TIFF file that holds the padded text)."""
    prepare(session(docs))
    rows = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches):
        for b in batches:
            texts = utf8_list(b.column(b.num_columns - 1))
            columns = [*b.columns[:-1], pa.array([len(t) for t in texts], pa.int64()), pa.array([write_tiff(padded(t)) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[:-1], "n_bytes", "media"])

    return rows.mapInArrow(run, f"{_declared(rows)}, n_bytes long, media binary")


def with_pages(files: DataFrame, media: str = "media", keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` and pages, an array of the file's pages in order."""
    prepare(session(files))
    rows = files.select(*keep, F.col(media).alias("__media"))

    def run(batches):
        for b in batches:
            pages = [read_pages(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pages, PAGE_ARROW)], [*b.schema.names[:-1], "pages"])

    return rows.mapInArrow(run, f"{_declared(rows)}, pages array<{PAGE}>")


def page_rows(files: DataFrame, media: str = "media", keep: tuple = ("doc_id",)) -> DataFrame:
    """One row per page: ``keep``, page, width, height, samples, compression, pixels, feature, error."""
    return with_pages(files, media, keep).select(*keep, F.explode("pages").alias("p")).select(*keep, "p.*")


def op6_media_tiff(spark, sf_dir) -> DataFrame:
    stored = store_texts(documents(spark, sf_dir))
    described = stored.withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    read = with_pages(described, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    # joined once, so that many pages cost no more than their bytes
    payload = F.unhex(F.array_join(F.transform("pages", lambda p: F.hex(p["pixels"])), ""))
    held = read.select("*", payload.alias("payload"))
    return held.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.array_join(F.transform("pages", lambda p: p["feature"]), ";").alias("feature"),
    )
