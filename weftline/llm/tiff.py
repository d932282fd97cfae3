"""TIFF media columns: texts stored as images, and images walked page by page.

The reader follows the chain of image directories in either byte order,
decodes strips and tiles (none, PackBits, LZW, deflate), undoes the horizontal
predictor and returns one row for each page.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import sliced

#: Tags of the format, sizes of its field types, numbers of its compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, PLANES = 322, 323, 324, 325, 284
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
NAMES = {"none": NONE, "lzw": LZW, "deflate": DEFLATE, "packbits": PACKBITS}

#: Bytes of a row of the pages that hold texts, rows of a page and of a strip.
ROW, PAGE_ROWS, STRIP = 192, 1024, 64
#: Side of the tiles of the query's files.
TILE = 64


class Page(NamedTuple):
    width: int
    height: int
    bits: int
    samples: int
    compression: int
    predictor: int
    data: bytes


def packbits(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = at + 1
        while run < n and run - at < 128 and data[run] == data[at]:
            run += 1
        if run - at >= 3 or run == n and run - at == 2:
            out += bytes((257 - (run - at), data[at]))
        else:
            run = at + 1
            while run < n and run - at < 128 and not (data[run - 1 : run] * 3 == data[run - 1 : run + 2]):
                run += 1
            out.append(run - at - 1)
            out += data[at:run]
        at = run
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
                at += 1
            at += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    codes = [(256, 9)]
    known, size, word = {bytes([i]): i for i in range(256)}, 9, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in known:
            word = longer
            continue
        codes.append((known[word], size))
        known[longer] = len(known) + 2
        # the format widens one code early
        size = min(12, (len(known) + 2).bit_length())
        if len(known) + 2 >= 4094:
            codes.append((256, size))
            known, size = {bytes([i]): i for i in range(256)}, 9
        word = data[i : i + 1]
    if word:
        codes.append((known[word], size))
        size = min(12, (len(known) + 3).bit_length())
    codes.append((257, size))
    bits, held, out = 0, 0, bytearray()
    for code, width in codes:
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1
    if held:
        out.append(bits << 8 - held & 255)
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    out, words, size, last = [], [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
    bits = held = 0
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        if held < size:
            continue
        held -= size
        code, bits = bits >> held, bits & (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            del words[258:]
            size, last = 9, b""
            continue
        if code > len(words) or not last and code >= 256:
            raise ValueError("bad LZW code")
        word = words[code] if code < len(words) else last + last[:1]
        out.append(word)
        if last:
            words.append(last + word[:1])
        last = word
        size = min(12, (len(words) + 1).bit_length())
    return b"".join(out)


def _packed(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: packbits}[compression](data)


def _unpacked(data: bytes, compression: int) -> bytes:
    try:
        return {NONE: bytes, LZW: unlzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpackbits}[compression](data)
    except KeyError:
        raise ValueError(f"compression {compression} isn't supported") from None


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip: int = STRIP, tile: int = 0) -> bytes:
    """Pages of 8-bit samples (rows, width) as one little-endian file, in strips, or in square tiles if tile is set."""
    out, links = bytearray(struct.pack("<2sHI", b"II", 42, 0)), 4
    for page in pages:
        rows, width = page.shape
        if tile:
            padded = np.pad(page, ((0, -rows % tile), (0, -width % tile)))
            parts = [padded[y : y + tile, x : x + tile] for y in range(0, rows, tile) for x in range(0, width, tile)]
        else:
            parts = [page[y : y + strip] for y in range(0, rows, strip)]
        at, sizes = [], []
        for part in parts:
            if predictor == 2:
                part = np.hstack([part[:, :1], part[:, 1:] - part[:, :-1]])
            data = _packed(part.tobytes(), compression)
            at.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        layout = {TILE_WIDTH: (3, [tile]), TILE_HEIGHT: (3, [tile]), TILES: (4, at), TILE_SIZES: (4, sizes)} if tile else {STRIPS: (4, at), STRIP_ROWS: (4, [strip]), STRIP_SIZES: (4, sizes)}
        fields = {WIDTH: (4, [width]), HEIGHT: (4, [rows]), BITS: (3, [8]), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [1]), PREDICTOR: (3, [predictor])} | layout
        entries = []
        for tag, (kind, values) in sorted(fields.items()):
            data = struct.pack(f"<{len(values)}{'HI'[kind - 3]}", *values)
            if len(data) > 4:
                where, data = len(out), data
                out += data
                data = struct.pack("<I", where)
            entries.append(struct.pack("<HHI4s", tag, kind, len(values), data))
        struct.pack_into("<I", out, links, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        links = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directories(file: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    order = {b"II": "<", b"MM": ">"}.get(file[:2])
    if order is None or struct.unpack_from(order + "H", file, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", file, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", file, at)
        fields = {}
        for i in range(n):
            where = at + 2 + 12 * i
            tag, kind, count = struct.unpack_from(order + "HHI", file, where)
            if kind not in (1, 3, 4):
                continue
            where += 8
            if TYPE_SIZES[kind] * count > 4:
                (where,) = struct.unpack_from(order + "I", file, where)
            fields[tag] = list(struct.unpack_from(f"{order}{count}{'B_HI'[kind - 1]}", file, where))
        yield order, fields
        (at,) = struct.unpack_from(order + "I", file, at + 2 + 12 * n)


def read_tiff(file: bytes) -> Iterator[Page]:
    for order, f in _directories(file):
        width, height = f[WIDTH][0], f[HEIGHT][0]
        bits, samples = f.get(BITS, [1])[0], f.get(SAMPLES, [1])[0]
        compression, predictor = f.get(COMPRESSION, [NONE])[0], f.get(PREDICTOR, [1])[0]
        if bits not in (8, 16):
            raise ValueError(f"{bits}-bit samples aren't supported")
        if predictor not in (1, 2):
            raise ValueError(f"predictor {predictor} isn't supported")
        if samples > 1 and f.get(PLANES, [1])[0] != 1:
            raise ValueError("samples in planes of their own aren't supported")
        dtype = np.dtype(f"{order}u{bits // 8}")
        if TILES in f:
            tw, th = f[TILE_WIDTH][0], f[TILE_HEIGHT][0]
            across = -(-width // tw)
            places = [(i // across * th, i % across * tw, th, tw) for i in range(len(f[TILES]))]
            parts = zip(f[TILES], f[TILE_SIZES], places, strict=True)
        else:
            each = min(f.get(STRIP_ROWS, [height])[0], height) or 1
            places = [(i * each, 0, min(each, height - i * each), width) for i in range(len(f[STRIPS]))]
            parts = zip(f[STRIPS], f[STRIP_SIZES], places, strict=True)
        image = np.zeros((height, width, samples), dtype)
        for at, size, (y, x, rows, cols) in parts:
            data = np.frombuffer(_unpacked(file[at : at + size], compression), dtype)[: rows * cols * samples].reshape(rows, cols, samples)
            if predictor == 2:
                data = np.cumsum(data, axis=1, dtype=dtype.newbyteorder("="))
            image[y : y + rows, x : x + cols] = data[: height - y, : width - x]
        yield Page(width, height, bits, samples, compression, predictor, image.tobytes())


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b" " * ((-len(data)) % ROW or (0 if data else ROW))


class Layout(NamedTuple):
    compression: int
    predictor: int
    tile: int


#: Codecs by the lowest digit (base 8) of a text's checksum: three texts in eight have another than deflate.
CODECS = (LZW, PACKBITS, NONE, *[DEFLATE] * 5)


def layout_of(data: bytes) -> Layout:
    """The layout that a text's own bytes decide, so that equal texts give equal files."""
    crc = zlib.crc32(data)
    return Layout(CODECS[crc % 8], 1 + (crc >> 3) % 2, TILE * ((crc >> 4) % 2))


def store_texts(docs: DataFrame, compression: str | None = None, predictor: int = 2, tile: int = 0) -> DataFrame:
    """(doc_id, n_bytes, media): each text as one TIFF file, null as an empty text.

    The payload is the text in UTF-8 with spaces up to a multiple of 192, at
    least 192 bytes, as pages of 192 samples by 1024 rows or fewer. Rows are
    independent; equal texts give equal files. Without a compression each text
    decides its own codec, predictor and layout. Other columns are dropped;
    repeated rows and null ids are kept as they are.
    """
    fixed = None if compression is None else Layout(NAMES[compression], predictor, tile)

    def run(parts):
        for part in sliced(parts):
            n, media = [], []
            for text in part.column("text").to_pandas():
                data = payload_of(text)
                how = fixed or layout_of(data)
                n.append(len((text or "").encode()))
                rows = np.frombuffer(data, np.uint8).reshape(-1, ROW)
                media.append(write_tiff([rows[at : at + PAGE_ROWS] for at in range(0, len(rows), PAGE_ROWS)], how.compression, how.predictor, tile=how.tile))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


PAGES = "doc_id bigint, n_bytes bigint, page int, pages int, width int, height int, bits int, samples int, compression int, predictor int, data binary, media_bytes bigint, media_sha256 string, error string"


def tiff_pages(stored: DataFrame) -> DataFrame:
    """One row for each page of each file of (doc_id, n_bytes, media), in order.

    A file that can't be read gives one row with page null and the reason in
    error; a null one gives none.
    """

    def run(parts):
        for part in sliced(parts):
            at, rows = [], []
            for i, file in enumerate(part.column("media").to_pylist()):
                if file is None:
                    continue
                try:
                    found, error = list(read_tiff(file)), None
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    found, error = [None], f"{type(e).__name__}: {e}"
                digest = hashlib.sha256(file).hexdigest()
                for page, p in enumerate(found):
                    at.append(i)
                    rows.append((None, None, *[None] * 7, len(file), digest, error) if p is None else (page, len(found), *p, len(file), digest, None))
            kinds = [*[pa.int32()] * 8, pa.binary(), pa.int64(), pa.string(), pa.string()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 12
            own = pa.array(at, pa.int64())
            names = [c.split()[0] for c in PAGES.split(", ")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(own), part.column("n_bytes").take(own), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, PAGES)


DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def digests(pages: DataFrame) -> DataFrame:
    """One row for each file from its pages, which follow each other as tiff_pages returns them.

    A file that couldn't be read back fails the query: no document is dropped.

    feature: pages, rows, then over all samples their sum, how many values
    occur, and the sum of steps between neighbours in a row.
    """

    def one(rows: list[dict]) -> dict:
        data = b"".join(r["data"] for r in rows)
        a = np.frombuffer(data, np.uint8).reshape(-1, ROW).astype(np.int64)
        steps = int(np.abs(np.diff(a, axis=1)).sum())
        feature = f"{len(rows)}:{len(a)}:{int(a.sum())}:{len(np.unique(a))}:{steps}"
        r = rows[0]
        return {"doc_id": r["doc_id"], "n_bytes": r["n_bytes"], "payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "tail_crc32": zlib.crc32(data[-16:]), "media_bytes": r["media_bytes"], "media_sha256": r["media_sha256"], "feature": feature}

    schema = pa.schema([(n, {"bigint": pa.int64(), "string": pa.string()}[k]) for n, k in (c.split() for c in DIGEST.split(", "))])

    def run(parts):
        held: list[dict] = []
        for part in sliced(parts):
            done = []
            for r in part.to_pylist():
                if r["error"] is not None:
                    raise ValueError(f"the file of document {r['doc_id']} can't be read: {r['error']}")
                held.append(r)
                if r["page"] == r["pages"] - 1:
                    done.append(one(held))
                    held = []
            yield pa.RecordBatch.from_pylist(done, schema)

    return pages.mapInArrow(run, DIGEST)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return digests(tiff_pages(store_texts(docs)))
