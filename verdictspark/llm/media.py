"""Media columns: texts stored as baseline JPEG files and read back.

A payload's 64-byte groups become 8x8 blocks whose quantised coefficients carry the
bytes: byte b is the category-8 value b (b >= 128) or b - 255, whose magnitude bits
are b itself, so the file is lossless. Each block is a restart interval; a COM segment
holds the payload's length. The reader parses the markers, Huffman-decodes the scans
of many files at once (a step per coefficient, in lockstep over restart intervals)
and reconstructs the luminance thumbnail from the DC terms, a pixel a block.

Null and empty texts are stored as one block of zero bytes. Equal texts, repeated rows among
them, have equal files, thumbnails and hashes; there are no ties to break. A very long text is
one file, held in one task with some 25 times its bytes. An empty table gives no rows. Only
the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from verdictspark.llm.tables import read
from verdictspark.llm.words import buffers, pieces

ROW_BLOCKS = 64
MOST_ROWS = 8191
LOCKSTEP = 1 << 14
#: One code of one bit for category 8, in the DC and in the AC table.
_DHT = b"\xff\xc4" + struct.pack(">H", 2 + 2 * 18) + b"".join(bytes([kind, 1] + [0] * 15 + [8]) for kind in (0x00, 0x10))
_DQT = b"\xff\xdb" + struct.pack(">H", 67) + bytes([0]) + bytes([4] * 64)
_DRI = b"\xff\xdd" + struct.pack(">HH", 4, 1)
_SOS = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0x00, 0, 63, 0)


def payload_of(text: bytes) -> bytes:
    """The text followed by zero bytes up to a positive multiple of 64."""
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def encode(payload: bytes) -> bytes:
    """A baseline JPEG file that holds the payload, whose length is a multiple of 64."""
    n = len(payload) // 64
    down = min(MOST_ROWS, -(-n // ROW_BLOCKS))
    across = -(-n // down)
    blocks = np.zeros((across * down, 64), dtype=np.uint8)
    blocks[:n] = np.frombuffer(payload, dtype=np.uint8).reshape(n, 64)
    b = blocks.reshape(-1, 8)
    bits = np.zeros((len(b), 9), dtype=np.uint8)
    for j in range(8):
        bits[:, j] |= b[:, j] >> (j + 1) if j < 7 else 0
        bits[:, j + 1] |= (b[:, j] & ((1 << (j + 1)) - 1)) << (7 - j)
    body = bits.reshape(len(blocks), 72)
    # Behind each block stand its stuffed zeros and its restart marker.
    full = body == 0xFF
    step = np.ones(body.shape, dtype=np.int64) + full
    step[:, -1] += 2
    step[-1, -1] -= 2
    at = np.cumsum(step.ravel()) - step.ravel()
    out = np.zeros(int(step.sum()), dtype=np.uint8)
    out[at] = body.ravel()
    marks = (at.reshape(body.shape)[:, -1] + 1 + full[:, -1])[:-1]
    out[marks] = 0xFF
    out[marks + 1] = 0xD0 + np.arange(len(marks)) % 8
    sof = b"\xff\xc0" + struct.pack(">HBHHBBBB", 11, 8, down * 8, across * 8, 1, 1, 0x11, 0)
    note = b"payload=%d" % len(payload)
    com = b"\xff\xfe" + struct.pack(">H", 2 + len(note)) + note
    return b"\xff\xd8" + com + _DQT + sof + _DHT + _DRI + _SOS + out.tobytes() + b"\xff\xd9"


@dataclass
class Parsed:
    width: int
    height: int
    blocks: int
    every: int
    quant_dc: int
    tables: tuple[bytes, bytes]
    payload: int
    scan: bytes


def parse(data: bytes) -> Parsed:
    """The markers of a baseline JPEG with one component; ValueError for other files."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, huff, frame, every, payload = 2, {}, {}, None, 0, -1
    while True:
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        kind = data[at + 1]
        size = struct.unpack_from(">H", data, at + 2)[0]
        seg, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            k = 0
            while k < len(seg):
                wide = seg[k] >> 4
                quant[seg[k] & 15] = struct.unpack_from(">H", seg, k + 1)[0] if wide else seg[k + 1]
                k += 1 + 64 * (1 + wide)
        elif kind == 0xC4:
            k = 0
            while k < len(seg):
                n = sum(seg[k + 1 : k + 17])
                huff[seg[k]] = seg[k + 1 : k + 17 + n]
                k += 17 + n
        elif kind == 0xC0:
            if seg[0] != 8 or seg[5] != 1:
                raise ValueError("8-bit files of one component only")
            frame = (*struct.unpack_from(">HH", seg, 1), seg[8])
        elif 0xC1 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("not baseline")
        elif kind == 0xDD:
            every = struct.unpack(">H", seg)[0]
        elif kind == 0xFE and seg.startswith(b"payload="):
            payload = int(seg[8:])
        elif kind == 0xDA:
            break
    if frame is None:
        raise ValueError("no frame")
    height, width, q = frame
    blocks = -(-width // 8) * -(-height // 8)
    end = data.rfind(b"\xff\xd9")
    return Parsed(width, height, blocks, every, quant[q], (huff[seg[2] >> 4], huff[0x10 | seg[2] & 15]), payload, data[at:end])


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits, the length of the code that they begin with (0: none) and its symbol."""
    lengths, symbols = np.zeros(1 << 16, dtype=np.uint8), np.zeros(1 << 16, dtype=np.uint8)
    code, k = 0, 16
    for size in range(1, 17):
        for _ in range(table[size - 1]):
            lo = code << (16 - size)
            lengths[lo : lo + (1 << (16 - size))] = size
            symbols[lo : lo + (1 << (16 - size))] = table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return lengths, symbols


def _segments(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scan bytes without stuffing and markers, and where each restart interval begins and ends."""
    lead = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[lead + 1]
    stuffed, marks = lead[after == 0], lead[(after >= 0xD0) & (after <= 0xD7)]
    stays = np.ones(len(scan), dtype=bool)
    stays[stuffed + 1] = False
    stays[marks] = stays[marks + 1] = False
    place = np.cumsum(stays) - stays
    cuts = place[marks]
    return scan[stays], np.concatenate([[0], cuts]), np.concatenate([cuts, [int(stays.sum())]])


def decode_segments(data: np.ndarray, begin: np.ndarray, per: np.ndarray, tables: tuple[bytes, bytes]) -> np.ndarray:
    """Coefficients, in the file's order, of restart intervals: per[i] blocks from bit 8 * begin[i]."""
    dc, ac = _lookup(tables[0]), _lookup(tables[1])
    data = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    first = np.cumsum(per) - per
    out = np.zeros((int(per.sum()), 64), dtype=np.int16)
    for lo in range(0, len(begin), LOCKSTEP):
        pos = begin[lo : lo + LOCKSTEP].astype(np.int64) * 8
        todo, base = per[lo : lo + LOCKSTEP], first[lo : lo + LOCKSTEP]
        before = np.zeros(len(pos), dtype=np.int32)
        for block in range(int(todo.max(initial=0))):
            live = np.flatnonzero(todo > block)
            p, row = pos[live], base[live] + block
            diff, _, p = _symbol(data, p, *dc)
            before[live] += diff
            out[row, 0] = before[live]
            k = np.ones(len(live), dtype=np.int64)
            open_ = np.arange(len(live))
            while len(open_):
                value, symbol, moved = _symbol(data, p[open_], *ac)
                p[open_] = moved
                run, ends = symbol >> 4, symbol == 0
                spot = k[open_] + run
                real = (symbol & 15) > 0
                out[row[open_[real]], np.minimum(spot[real], 63)] = value[real]
                k[open_] = np.where(ends, 64, spot + 1)
                open_ = open_[k[open_] < 64]
            pos[live] = p
    return out


def _symbol(data: np.ndarray, pos: np.ndarray, lengths: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The value and symbol at each bit position, and the position behind them."""
    byte, bit = pos >> 3, (pos & 7).astype(np.uint64)
    word = np.zeros(len(pos), dtype=np.uint64)
    for j in range(5):
        word = word << np.uint64(8) | data[byte + j]
    head = (word >> (np.uint64(24) - bit)) & np.uint64(0xFFFF)
    size, symbol = lengths[head].astype(np.int64), symbols[head]
    if not size.all():
        raise ValueError("no such code")
    extra = (symbol & 15).astype(np.int64)
    raw = ((word >> (40 - bit.astype(np.int64) - size - extra).astype(np.uint64)) & ((1 << extra) - 1).astype(np.uint64)).astype(np.int32)
    low = (extra > 0) & (raw < (1 << np.maximum(extra - 1, 0)))
    return np.where(low, raw - (1 << extra) + 1, raw).astype(np.int32), symbol, pos + size + extra


def decode(files: list[bytes]) -> list[tuple[Parsed, np.ndarray]]:
    """Headers and coefficient blocks of JPEG files; intervals with like tables go together."""
    heads = [parse(f) for f in files]
    out: list[tuple[Parsed, np.ndarray] | None] = [None] * len(files)
    like: dict[tuple[bytes, bytes], list[int]] = {}
    for i, h in enumerate(heads):
        like.setdefault(h.tables, []).append(i)
    for tables, members in like.items():
        joined = np.frombuffer(b"\xff\xd0".join(heads[i].scan for i in members), dtype=np.uint8)
        data, begin, _ = _segments(joined)
        per = []
        for i in members:
            h = heads[i]
            every = h.every or h.blocks
            per += [every] * (h.blocks // every) + ([h.blocks % every] if h.blocks % every else [])
        if len(per) != len(begin):
            raise ValueError("restart intervals don't fit the frame")
        coef, at = decode_segments(data, begin, np.array(per), tables), 0
        for i in members:
            out[i] = (heads[i], coef[at : at + heads[i].blocks])
            at += heads[i].blocks
    return out


def payload_back(head: Parsed, coef: np.ndarray) -> bytes:
    """The stored payload; every interval of encode() is one block, so DC terms stand whole."""
    return np.where(coef > 0, coef, coef + 255).astype(np.uint8).tobytes()[: head.payload]


def thumbnail(head: Parsed, coef: np.ndarray) -> np.ndarray:
    """Luminance from the DC terms alone, a pixel for each 8x8 block."""
    level = np.clip((coef[:, 0].astype(np.int32) * head.quant_dc >> 3) + 128, 0, 255).astype(np.uint8)
    return level.reshape(-(-head.height // 8), -(-head.width // 8))


def thumbnail_hash(image: np.ndarray) -> str:
    """64 bits: cells of an 8x8 grid that are brighter than the mean cell."""
    y, x = np.arange(9) * image.shape[0] // 8, np.arange(9) * image.shape[1] // 8
    sums = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    sums[1:, 1:] = image.cumsum(0, dtype=np.float64).cumsum(1)
    y2, x2 = np.maximum(y[1:], y[:-1] + 1), np.maximum(x[1:], x[:-1] + 1)
    cell = sums[np.ix_(y2, x2)] - sums[np.ix_(y[:-1], x2)] - sums[np.ix_(y2, x[:-1])] + sums[np.ix_(y[:-1], x[:-1])]
    cell /= np.outer(y2 - y[:-1], x2 - x[:-1])
    return np.packbits(cell.ravel() > cell.mean()).tobytes().hex()


_COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def media_columns(docs: DataFrame, text: str = "text", id_col: str = "doc_id", with_media: bool = False) -> DataFrame:
    """Stores each text as JPEG and adds what is read back; with_media keeps the file itself."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, {_COLUMNS}" + (", media binary" if with_media else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            data, at = buffers(batch.column("text"))
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            files = [encode(payload_of(t)) for t in texts]
            rows = []
            for t, f, (head, coef) in zip(texts, files, decode(files), strict=True):
                back, small = payload_back(head, coef), thumbnail(head, coef)
                look = f"{head.width}x{head.height}:{thumbnail_hash(small)}:{hashlib.sha256(small.tobytes()).hexdigest()[:16]}"
                rows.append((len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(f), hashlib.sha256(f).hexdigest(), look, head.width, head.height))
            columns = [batch.column("id"), *(pa.array(c) for c in zip(*rows, strict=True))]
            columns[-2:] = [c.cast(pa.int32()) for c in columns[-2:]]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(files, pa.binary())] if with_media else []), names=names)

    return docs.select(docs[id_col].alias("id"), docs[text].alias("text")).mapInArrow(run, schema)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a JPEG file: sizes, hashes and the thumbnail's feature."""
    return media_columns(read(spark, sf_dir, "documents"))
