"""Baseline JPEG columns: markers, Huffman scans, DC thumbnails, all in numpy.

The decoder reads baseline JPEG with any Huffman tables, sampling factors and restart intervals. Scans
are decoded in lockstep: every restart interval of every picture of a batch is a lane with its own bit
position, and each step decodes one symbol in all lanes. From the DC coefficients of the luminance alone
it rebuilds a thumbnail of one pixel a block, and hashes it.

A payload is stored in the unit of the format, the quantised coefficient: 64 bytes are one block. A byte
is the coefficient whose eight extra bits it is, so all coefficients have size 8 and the Huffman tables
hold one code of one bit. Each block is its own restart interval (the DC is not predicted), which makes
every coefficient nine bits and a block 72 bytes before stuffing. Any JPEG reader opens the result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, released, text_slices

BLOCK = 64
NOTE = b"blocks="
#: Bytes of payload that are stored and decoded together.
BATCH_BYTES = 2_000_000

#: Markers of the format (fixed values).
SOI, EOI, SOF0, DHT, SOS, DQT, DRI, COM, RST0 = 0xD8, 0xD9, 0xC0, 0xC4, 0xDA, 0xDB, 0xDD, 0xFE, 0xD0


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(blocks: int) -> bytes:
    across = int(np.ceil(np.sqrt(blocks)))
    down = -(-blocks // across)
    one_code = bytes([1] + [0] * 15 + [8])
    return b"".join([
        bytes([0xFF, SOI]),
        segment(COM, NOTE + str(blocks).encode()),
        segment(DQT, bytes([0]) + bytes([1] * 64)),
        segment(SOF0, struct.pack(">BHHBBBB", 8, down * 8, across * 8, 1, 1, 0x11, 0)),
        segment(DHT, bytes([0x00]) + one_code),
        segment(DHT, bytes([0x10]) + one_code),
        segment(DRI, struct.pack(">H", 1)),
        segment(SOS, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def store(payloads: list[bytes]) -> list[bytes]:
    """A JPEG of each payload; lengths are positive multiples of 64."""
    if not payloads:
        return []
    flat = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    bits = np.zeros((len(flat), BLOCK, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(flat, axis=1).reshape(-1, BLOCK, 8)
    coded = np.packbits(bits.reshape(len(flat), -1), axis=1)
    void = np.packbits(np.zeros(BLOCK * 9, np.uint8))
    out, at = [], 0
    for p in payloads:
        n = len(p) // BLOCK
        across = int(np.ceil(np.sqrt(n)))
        total = across * -(-n // across)
        own = np.concatenate([coded[at : at + n], np.tile(void, (total - n, 1))]) if total > n else coded[at : at + n]
        marks = np.stack([np.full(total, 0xFF, np.uint8), (RST0 + np.arange(total) % 8).astype(np.uint8)], axis=1)
        if (own == 0xFF).any():
            body = b"".join(b.tobytes().replace(b"\xff", b"\xff\x00") + m.tobytes() for b, m in zip(own, marks, strict=True))
        else:
            body = np.concatenate([own, marks], axis=1).tobytes()
        out.append(header(n) + body[:-2] + bytes([0xFF, EOI]))
        at += n
    return out


@dataclass
class Component:
    id: int
    across: int  # sampling factors
    down: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Picture:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray]
    tables: dict[int, bytes]
    restart: int
    note: bytes
    data: np.ndarray  # the scan without stuffing and markers
    starts: np.ndarray  # of the restart intervals in it

    def mcus(self) -> tuple[int, int]:
        h, v = max(c.across for c in self.components), max(c.down for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def order(self) -> list[int]:
        """The component of each block of an MCU; a scan of one component has one block an MCU."""
        return [k for k, c in enumerate(self.components) for _ in range(c.across * c.down)]


def parse(jpeg: bytes) -> Picture:
    """Markers and tables of a baseline JPEG with one scan; ValueError for anything else."""
    if jpeg[:2] != bytes([0xFF, SOI]):
        raise ValueError("no JPEG")
    at, restart, note = 2, 0, b""
    quants: dict[int, np.ndarray] = {}
    tables: dict[int, bytes] = {}
    frame: tuple[int, int] | None = None
    components: list[Component] = []
    while True:
        if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = jpeg[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        length = struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == COM:
            note = body
        elif marker == DRI:
            restart = struct.unpack(">H", body)[0]
        elif marker == DQT:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == DHT:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == SOF0:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not height or not width:
                raise ValueError("not a baseline frame of known size")
            frame = (width, height)
            components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            if n == 1:
                components[0].across = components[0].down = 1
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == SOS:
            if frame is None or body[0] != len(components):
                raise ValueError("not one scan of all components")
            for k in range(body[0]):
                c = next(c for c in components if c.id == body[1 + 2 * k])
                c.dc, c.ac = body[2 + 2 * k] >> 4, 0x10 | body[2 + 2 * k] & 15
            break
    scan = np.frombuffer(jpeg, np.uint8, offset=at)
    high = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[high + 1]
    ends = high[(after != 0) & ((after < RST0) | (after > RST0 + 7))]
    if not len(ends):
        raise ValueError("the scan has no end")
    end = int(ends[0])
    high, after = high[high < end], after[high < end]
    stuffed, resets = high[after == 0] + 1, high[after != 0]
    gone = np.concatenate([stuffed, resets, resets + 1])
    keep = np.ones(end, bool)
    keep[gone] = False
    before = np.cumsum(np.r_[0, keep])
    starts = np.r_[0, before[resets]]
    return Picture(*frame, components, quants, tables, restart, note, scan[:end][keep], starts)


def lookup(table: bytes) -> np.ndarray:
    """For each 16 bits: the length of the code that they begin with, and its symbol (length << 8 | symbol); 0: none."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = length << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def decode_blocks(pictures: list[Picture]) -> list[np.ndarray]:
    """Quantised coefficients in scan order, (blocks, 64), of pictures with the same tables and MCU.

    All restart intervals are decoded at once; a lane that has read its blocks leaves.
    """
    first = pictures[0]
    order = first.order()
    luts = np.stack([lookup(first.tables[t]) for c in first.components for t in (c.dc, c.ac)])
    data, lanes_at, lanes_blocks, totals = [], [], [], []
    offset = 0
    for p in pictures:
        across, down = p.mcus()
        total = across * down
        each = p.restart or total
        counts = np.full(-(-total // each), each)
        counts[-1] = total - each * (len(counts) - 1)
        if len(counts) != len(p.starts):
            raise ValueError("restart intervals are missing")
        lanes_at.append(p.starts + offset)
        lanes_blocks.append(counts * len(order))
        totals.append(total * len(order))
        data.append(p.data)
        offset += len(p.data)
    flat = np.concatenate([*data, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = (flat[:-3] << np.uint32(24)) | (flat[1:-2] << np.uint32(16)) | (flat[2:-1] << np.uint32(8)) | flat[3:]
    bit = np.concatenate(lanes_at) * 8
    last = np.r_[np.concatenate(lanes_at)[1:], offset] * 8
    blocks = np.concatenate(lanes_blocks)
    base = np.cumsum(blocks) - blocks
    out = np.zeros((int(blocks.sum()), 64), np.int16)
    flat_out = out.ravel()
    mcu = np.array(order)
    lane = np.arange(len(bit))
    block, k = np.zeros(len(bit), np.int64), np.zeros(len(bit), np.int64)
    dc = np.zeros((len(bit), len(first.components)), np.int64)

    def peek(at: np.ndarray, n: int) -> np.ndarray:
        at = np.minimum(at, offset * 8)
        return (window[at >> 3] >> (32 - n - (at & 7)).astype(np.uint32)).astype(np.int64) & ((1 << n) - 1)

    while len(lane):
        part = mcu[block % len(mcu)] if len(mcu) > 1 else 0
        found = luts[2 * part + (k > 0), peek(bit, 16)]
        length, symbol = found >> 8, found & 0xFF
        if not length.all():
            raise ValueError("a code that the table does not have")
        run, size = symbol >> 4, symbol & 15
        is_dc = k == 0
        extra = peek(bit + length, 16) >> (16 - size)
        bit = bit + length + size
        if (bit > last[lane]).any():
            raise ValueError("an interval ends early")
        value = np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)
        if is_dc.any():
            at = lane[is_dc], (part[is_dc] if len(mcu) > 1 else 0)
            dc[at] += value[is_dc]
            value[is_dc] = dc[at]
            run = np.where(is_dc, 0, run)
        ends = ~is_dc & (symbol == 0)
        at = k + run
        put = (size > 0) | is_dc
        if (at[put & ~ends] > 63).any():
            raise ValueError("a block is too long")
        flat_out[((base[lane] + block) * 64 + at)[put & ~ends]] = value[put & ~ends]
        k = np.where(ends, 64, at + 1)
        full = k >= 64
        if full.any():
            block, k = block + full, np.where(full, 0, k)
            stay = block < blocks[lane]
            if not stay.all():
                lane, block, k, bit = lane[stay], block[stay], k[stay], bit[stay]
    edges = np.cumsum([0, *totals])
    return [out[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def decode(jpegs: list[bytes]) -> list[tuple[Picture, np.ndarray]]:
    """Each picture with its coefficients; pictures with the same tables are decoded together."""
    pictures = [parse(j) for j in jpegs]
    alike: dict[tuple, list[int]] = {}
    for k, p in enumerate(pictures):
        alike.setdefault((tuple(sorted(p.tables.items())), tuple((c.across, c.down, c.dc, c.ac) for c in p.components)), []).append(k)
    found: dict[int, np.ndarray] = {}
    for group in alike.values():
        found.update(zip(group, decode_blocks([pictures[k] for k in group]), strict=True))
    return [(p, found[k]) for k, p in enumerate(pictures)]


def thumbnail(picture: Picture, blocks: np.ndarray) -> np.ndarray:
    """Luminance of one pixel a block, from the DC coefficients alone."""
    across, down = picture.mcus()
    y = picture.components[0]
    n = len(picture.order())
    dc = blocks[:, 0].reshape(-1, n)[:, : y.across * y.down].astype(np.int64)
    grid = dc.reshape(down, across, y.down, y.across).transpose(0, 2, 1, 3).reshape(down * y.down, across * y.across)
    grid = grid[: -(-picture.height // 8), : -(-picture.width // 8)] if n > 1 else grid
    return np.clip(np.rint(grid * picture.quants[y.quant][0] / 8 + 128), 0, 255).astype(np.uint8)


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which of 8x8 equal parts are brighter than the mean; small pictures repeat pixels."""
    rows = np.arange(9) * thumb.shape[0] // 8
    cols = np.arange(9) * thumb.shape[1] // 8
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    total[1:, 1:] = thumb.astype(np.float64).cumsum(0).cumsum(1)
    top, left = np.minimum(rows[:8], thumb.shape[0] - 1), np.minimum(cols[:8], thumb.shape[1] - 1)
    bottom, right = np.maximum(rows[1:], top + 1), np.maximum(cols[1:], left + 1)
    sums = total[np.ix_(bottom, right)] - total[np.ix_(top, right)] - total[np.ix_(bottom, left)] + total[np.ix_(top, left)]
    means = sums / ((bottom - top)[:, None] * (right - left)[None, :])
    return np.packbits(means > means.mean()).tobytes().hex()


def features(picture: Picture, blocks: np.ndarray) -> str:
    """Dimensions, the thumbnail's SHA-256 (16 digits) and its average hash."""
    thumb = thumbnail(picture, blocks)
    return f"{picture.width}x{picture.height}:{hashlib.sha256(thumb.tobytes()).hexdigest()[:16]}:{average_hash(thumb)}"


def stored_payload(picture: Picture, blocks: np.ndarray) -> bytes:
    """The payload that ``store`` put into the coefficients."""
    n = int(picture.note[len(NOTE) :])
    own = blocks[:n].astype(np.int64)
    return np.where(own < 0, own + 255, own).astype(np.uint8).tobytes()


def add_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, media`` for every row: the text's UTF-8, padded with zeros to a positive multiple of 64, as JPEG.

    Null texts count as empty. Repeated rows repeat, other columns are not read, an empty table gives an
    empty result; a text of any length is stored whole (the format ends at 4 GB).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, decoded in text_slices(batch):
                texts = [t.encode() for t in decoded]
                for part in by_size([len(t) for t in texts]):
                    padded = [t + bytes(-len(t) % BLOCK or BLOCK * (not t)) for t in texts[part]]
                    columns = [some.column(0)[part.start : part.stop], pa.array([len(t) for t in texts[part]], pa.int64()), pa.array(store(padded), pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(run), f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary")


def by_size(sizes: list[int], most: int = BATCH_BYTES) -> Iterator[slice]:
    start = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(start, k)
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def read_media(media: DataFrame) -> DataFrame:
    """``id, n_bytes`` and what the stored bytes of ``media`` hold: the payload's digests, the form's, the feature."""
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, len(b), SLICE_ROWS)):
            stored = batch.column(2).to_pylist()
            for part in by_size([len(m) for m in stored]):
                pictures = decode(stored[part])
                payloads = [stored_payload(*p) for p in pictures]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[part.start : part.stop],
                    batch.column(1)[part.start : part.stop],
                    pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([zlib.crc32(p[-BLOCK:]) for p in payloads], pa.int64()),
                    pa.array([len(m) for m in stored[part]], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in stored[part]]),
                    pa.array([features(*p) for p in pictures]),
                ], names)

    kind = media.schema["id"].dataType.simpleString()
    return media.select("id", "n_bytes", "media").mapInArrow(released(run), f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
