"""TIFF pages from a binary column: directory walk, strips or tiles, PackBits, LZW and deflate.

``decode`` follows the chain of image directories of one file and yields one page
each; ``tiff_pages`` does so for a column and emits one row per page, the pages of a
file one after another. ``encode`` writes the same subset (8-bit samples, one file
from one or more pages), so that stored bytes can be read back by the full path.

A file that is broken, null or empty gives one row with ``error`` set and page null,
after the rows of the pages before the fault; nothing is raised in a task. Repeated
rows each get their pages. Extra columns are repeated on each page; those named as the
columns of a page are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import map_lists

# Fixed values of the format: tag numbers, field sizes and compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
FIELD = {1: "B", 3: "H", 4: "I"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
CLEAR, EOI = 256, 257


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1:i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1:i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def pack_bits(row: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(a: int, b: int) -> None:
        for i in range(a, b, 128):
            part = row[i:min(i + 128, b)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _RUN.finditer(row):
        literal(at, m.start())
        out.extend((257 - (m.end() - m.start()), row[m.start()]))
        at = m.end()
    literal(at, len(row))
    return bytes(out)


def _lzw_width(next_code: int) -> int:
    """Bits of the next code when the table's next entry is ``next_code``: one early, 9 to 12."""
    return min(12, max(9, (next_code + 1).bit_length()))


#: Width of the n-th code after a CLEAR, for writer and reader alike, and where its bits begin; tables are cleared before 4096 entries.
_WIDTHS = np.array([_lzw_width(max(258, 257 + n)) for n in range(4096)])
_STARTS = np.concatenate([[0], np.cumsum(_WIDTHS)[:-1]])


def _lzw_codes(data: bytes):
    """Runs of codes, each begun anew by a CLEAR; a run's codes are cut out of the bits in one step, as their widths are known."""
    padded = np.frombuffer(data + bytes(4), np.uint8).astype(np.int64)
    at, end = 0, len(data) * 8
    while at < end:
        n = int(np.searchsorted(_STARTS + _WIDTHS, end - at, "right"))
        starts, widths = at + _STARTS[:n], _WIDTHS[:n]
        low = starts >> 3
        window = padded[low] << 24 | padded[low + 1] << 16 | padded[low + 2] << 8 | padded[low + 3]
        codes = window >> (32 - (starts & 7) - widths) & ((1 << widths) - 1)
        stop = np.flatnonzero((codes == CLEAR) | (codes == EOI))
        if not len(stop):
            yield codes.tolist()
            if n == len(_WIDTHS):
                raise ValueError("LZW table overflow")
            return
        first = int(stop[0])
        yield codes[:first].tolist()
        if codes[first] == EOI:
            return
        at += int(_STARTS[first] + _WIDTHS[first])


def lzw_decode(data: bytes) -> bytes:
    single = [bytes((b,)) for b in range(256)] + [b"", b""]
    out: list[bytes] = []
    for codes in _lzw_codes(data):
        table, previous = list(single), b""
        for code in codes:
            if not previous:
                previous = table[code]
                out.append(previous)
                continue
            entry = table[code] if code < len(table) else previous + previous[:1]
            table.append(previous + entry[:1])
            out.append(entry)
            previous = entry
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    # each run of codes after a CLEAR has the widths of _WIDTHS; the CLEAR or EOI that ends it counts as its last
    codes, widths = [np.array([CLEAR])], [_WIDTHS[:1]]
    run: list[int] = []
    table: dict[int, int] = {}
    size, current = 258, -1

    def close(end: int) -> None:
        run.append(end)
        codes.append(np.array(run))
        widths.append(_WIDTHS[:len(run)])
        run.clear()

    for b in data:
        if current < 0:
            current = b
            continue
        longer = table.get(current << 8 | b)
        if longer is not None:
            current = longer
            continue
        run.append(current)
        table[current << 8 | b], size, current = size, size + 1, b
        if size >= 4094:
            run.append(current)
            close(CLEAR)
            table, size, current = {}, 258, -1
    if current >= 0:
        run.append(current)
    close(EOI)
    code, width = np.concatenate(codes)[:, None], np.concatenate(widths)[:, None]
    places = np.arange(11, -1, -1)
    return np.packbits((code >> places & 1).astype(np.uint8)[places < width]).tobytes()


CODECS = {
    NONE: (bytes, bytes), PACKBITS: (pack_bits, unpack_bits), LZW: (lzw_encode, lzw_decode),
    DEFLATE: (lambda x: zlib.compress(x, 1), zlib.decompress), OLD_DEFLATE: (lambda x: zlib.compress(x, 1), zlib.decompress),
}


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 64,
           tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian TIFF of 8-bit pages (height x width [x samples])."""
    head, body, at = bytearray(b"II*\0\0\0\0\0"), bytearray(), 8
    link = 4
    pack = CODECS[compression][0]
    for page in pages:
        page = page[:, :, None] if page.ndim == 2 else page
        h, w, s = page.shape
        if tile:
            tw, th = tile
            full = np.zeros((-(-h // th) * th, -(-w // tw) * tw, s), np.uint8)
            full[:h, :w] = page
            parts = [full[y:y + th, x:x + tw] for y in range(0, full.shape[0], th) for x in range(0, full.shape[1], tw)]
        else:
            parts = [page[y:y + rows_per_strip] for y in range(0, h, rows_per_strip)]
        if predictor == 2:
            parts = [np.concatenate([p[:, :1], np.diff(p, axis=1)], axis=1) for p in parts]
        if compression == PACKBITS:  # rows are packed one by one
            chunks = [b"".join(pack(r.tobytes()) for r in p) for p in parts]
        else:
            chunks = [pack(p.tobytes()) for p in parts]
        offsets, sizes = [], [len(c) for c in chunks]
        for c in chunks:
            offsets.append(at)
            body += c + b"\0" * (len(c) % 2)
            at += len(c) + len(c) % 2
        tags = {WIDTH: [w], HEIGHT: [h], BITS: [8] * s, COMPRESSION: [compression], PHOTOMETRIC: [1 if s < 3 else 2], SAMPLES: [s], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [tile[0]], TILE_HEIGHT: [tile[1]], TILE_OFFSETS: offsets, TILE_BYTES: sizes} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [rows_per_strip], STRIP_BYTES: sizes}
        directory, extra, base = struct.pack("<H", len(tags)), b"", at + 2 + 12 * len(tags) + 4
        for tag in sorted(tags):
            values = tags[tag]
            kind = 3 if tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PREDICTOR) else 4
            raw = struct.pack(f"<{len(values)}{FIELD[kind]}", *values)
            if len(raw) <= 4:
                cell = raw.ljust(4, b"\0")
            else:
                cell = struct.pack("<I", base + len(extra))
                extra += raw + b"\0" * (len(raw) % 2)
            directory += struct.pack("<HHI", tag, kind, len(values)) + cell
        target = head if link == 4 else body
        struct.pack_into("<I", target, link if link == 4 else link - 8, at)
        link = at + len(directory)
        body += directory + b"\0\0\0\0" + extra
        at = 8 + len(body)
    return bytes(head + body)


def decode(data: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(compression, predictor, pixels of height x width x samples) per image directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, tuple[int, ...]] = {}
        for k in range(n):
            entry = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
            if kind in FIELD:
                fmt = f"{order}{count}{FIELD[kind]}"
                place = entry + 8 if struct.calcsize(fmt) <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
                tags[tag] = struct.unpack_from(fmt, data, place)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        one = lambda tag, default=None: tags.get(tag, (default,))[0]
        w, h, s = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        compression, predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
        if set(tags.get(BITS, (1,))) != {8} or compression not in CODECS or predictor not in (1, 2):
            raise ValueError("only 8-bit samples with known compression and predictor")
        if s > 1 and one(PLANAR, 1) != 1:
            raise ValueError("only samples stored together")
        unpack, pixels = CODECS[compression][1], np.zeros((h, w, s), np.uint8)
        tw, th = (one(TILE_WIDTH), one(TILE_HEIGHT)) if TILE_OFFSETS in tags else (w, one(ROWS_PER_STRIP, h))
        places = zip(tags[TILE_OFFSETS], tags[TILE_BYTES]) if TILE_OFFSETS in tags else zip(tags[STRIP_OFFSETS], tags[STRIP_BYTES])
        across = -(-w // tw)
        for k, (start, size) in enumerate(places):
            y, x = k // across * th, k % across * tw
            rows = th if TILE_OFFSETS in tags else min(th, h - y)
            part = np.frombuffer(unpack(data[start:start + size]), np.uint8, rows * tw * s).reshape(rows, tw, s)
            if predictor == 2:
                part = np.add.accumulate(part, axis=1, dtype=np.uint8)
            pixels[y:y + th, x:x + tw] = part[:h - y, :w - x]
        yield compression, predictor, pixels


PAGE_SCHEMA = "page int, width int, height int, samples int, compression int, predictor int, pixels binary, error string"


def tiff_pages(df: DataFrame, content: str = "content") -> DataFrame:
    """One row per page: the columns of ``df`` and those of PAGE_SCHEMA (which replace any of that name)."""
    names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]
    kept = [c for c in df.columns if c not in names]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c in kept) + ", " + PAGE_SCHEMA

    def rows(data: bytes | None) -> Iterator[tuple]:
        try:
            if not data:
                raise ValueError("no content")
            for k, (c, q, p) in enumerate(decode(data)):
                yield k, p.shape[1], p.shape[0], p.shape[2], c, q, p.tobytes(), None
        except (ValueError, KeyError, TypeError, IndexError, struct.error, zlib.error) as e:
            yield (None,) * 7 + (f"{type(e).__name__}: {e}",)

    target = to_arrow_schema(StructType.fromDDL(PAGE_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                found = [(i, *r) for i, data in enumerate(part[content].to_pylist()) for r in rows(data)]
                which, *made = zip(*found)
                old = part.select(kept).take(pa.array(which))
                yield pa.RecordBatch.from_arrays(
                    [*old.columns, *(pa.array(x, f.type) for x, f in zip(made, target))], names=[*kept, *names])

    # a column that is replaced may still be the content
    return df.select(*(f"`{c}`" for c in dict.fromkeys([*kept, content]))).mapInArrow(run, schema)


ROW = 576
PAGE_ROWS = 48
#: (compression, predictor, tile) of the forms in which texts are stored, an equal share of texts each.
FORMS = ((PACKBITS, 1, None), (LZW, 1, None), (DEFLATE, 2, None), (DEFLATE, 2, (192, 96)), (LZW, 2, (288, 32)), (OLD_DEFLATE, 1, None))


def store_text(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, TIFF file of them): 255 fills up the last of the 576-byte rows, PAGE_ROWS rows are a page.

    A checksum of the text picks the form, so that each decoder meets texts of every length and
    equal texts are stored alike.
    """
    raw = (text or "").encode()
    rows = max(1, -(-len(raw) // ROW))
    image = np.frombuffer(raw + b"\xff" * (rows * ROW - len(raw)), np.uint8).reshape(rows, ROW)
    compression, predictor, tile = FORMS[zlib.crc32(raw) % len(FORMS)]
    return len(raw), encode([image[k:k + PAGE_ROWS] for k in range(0, rows, PAGE_ROWS)], compression, predictor, 16, tile)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, content: every whole text as a TIFF file."""

    def step(part: dict[str, list]) -> dict[str, list]:
        made = [store_text(t) for t in part["text"]]
        return {"doc_id": part["doc_id"], "n_bytes": [n for n, _ in made], "content": [c for _, c in made]}

    return map_lists(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                     lambda: step, "doc_id long, n_bytes long, content binary")
