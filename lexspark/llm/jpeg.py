"""Media columns: baseline JPEG files written and read in numpy.

A payload byte is the DC level of one 8x8 block: with a quantiser of 8 a block with level ``v - 128`` is a flat square
of brightness ``v``, so the DC-only thumbnail of the picture, one sample per block, *is* the payload. Level differences
are Huffman-coded as in any baseline file. Every row of blocks is one restart interval, which gives the decoder
independent segments: it walks all segments of an Arrow batch in step, one symbol at a time, with numpy vectors.

The decoder reads general baseline files too (several components and sampling factors, AC coefficients skipped).

Style: an Arrow map; bit streams have no counterpart among the built-in functions. No shuffle, no state, and memory
is bounded by the slice of a batch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

UNIT = 64
#: Blocks in a row of the narrowest picture; wider ones are multiples of it, so that no side passes 65,535 pixels.
ROW = 64
MOST_ROWS, MOST_ROW = 8191, 8128
#: Payload bytes in one picture; a longer payload is stored as several pictures, one after the other.
PICTURE = 8192 * UNIT * 8

# Code lengths and symbols of the usual table for luminance DC levels.
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)
#: The only AC symbol that flat blocks need is the end of block.
AC_COUNTS = (1,) + (0,) * 15
AC_SYMBOLS = (0,)


def code_table(counts: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol to (code, length)."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[k : k + n]:
            out[s] = (code, length)
            code += 1
        k += n
        code <<= 1
    return out


def lookup(counts: tuple[int, ...], symbols: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit window: the symbol that starts it and its code length, 0 where there is none."""
    symbol, length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for s, (code, n) in code_table(counts, symbols).items():
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
    return symbol, length


# --- encoding -----------------------------------------------------------------------------------------------------


def _segment(kind: int, body: bytes) -> bytes:
    return bytes((0xFF, kind)) + (len(body) + 2).to_bytes(2, "big") + body


def _shape(n: int) -> tuple[int, int]:
    """Blocks in a row and rows for a payload of n bytes."""
    row = ROW * -(-n // (ROW * MOST_ROWS))
    return row, -(-n // row)


def _head(n: int, row: int, rows: int) -> bytes:
    return b"".join((
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
        _segment(0xFE, b"payload %d" % n),
        _segment(0xDB, b"\0" + bytes([8] * 64)),
        _segment(0xC0, b"\x08" + (8 * rows).to_bytes(2, "big") + (8 * row).to_bytes(2, "big") + b"\x01\x01\x11\0"),
        _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)),
        _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS)),
        _segment(0xDD, row.to_bytes(2, "big")),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


_CATEGORY = np.array([int(i).bit_length() for i in range(256)], np.int64)
_DC = code_table(DC_COUNTS, DC_SYMBOLS)
_DC_CODE = np.array([_DC[c][0] for c in range(12)], np.int64)
_DC_LEN = np.array([_DC[c][1] for c in range(12)], np.int64)


def _scan(levels: np.ndarray, row: int) -> list[bytes]:
    """The entropy-coded bytes of each row of blocks, stuffed; levels has a whole number of rows."""
    v = levels.astype(np.int64)
    diff = v.copy()
    diff[1:] -= v[:-1]
    diff[::row] = v[::row]
    category = _CATEGORY[np.abs(diff)]
    low = np.where(diff < 0, diff + (1 << category) - 1, diff)
    # code of the category, its extra bits, and a single 0 bit for the end of block
    bits = ((_DC_CODE[category] << category) | low) << 1
    size = _DC_LEN[category] + category + 1
    rows = len(v) // row
    ends = np.cumsum(size)
    last = ends[row - 1 :: row]
    length = np.diff(last, prepend=0)
    width = -(-length // 8)  # bytes of each row
    first = np.concatenate(([0], np.cumsum(width)[:-1])) * 8
    at = ends - size - np.repeat(last - length, row) + np.repeat(first, row)
    byte, shift = at >> 3, at & 7
    value = bits << (32 - size - shift)
    total = int(width.sum())
    out = np.zeros(total + 4, np.float64)
    for k in range(4):  # bits of different symbols never meet, so sums are unions
        part = (value >> (24 - 8 * k)) & 255
        keep = np.flatnonzero(part)
        out += np.bincount(byte[keep] + k, part[keep], total + 4)
    packed = out[:total].astype(np.uint8)
    tail = width * 8 - length
    packed[np.cumsum(width) - 1] |= ((1 << tail) - 1).astype(np.uint8)  # rows end in 1 bits
    raw, cut = packed.tobytes(), np.cumsum(width)
    return [raw[e - w : e].replace(b"\xff", b"\xff\x00") for e, w in zip(cut.tolist(), width.tolist(), strict=True)] if rows else []


def encode(payload: bytes) -> bytes:
    """A picture, or several in a row, whose DC levels are the payload's bytes."""
    out = []
    for k in range(0, max(1, len(payload)), PICTURE):
        part = payload[k : k + PICTURE]
        row, rows = _shape(len(part))
        levels = np.full(row * rows, -128, np.int16)
        levels[: len(part)] = np.frombuffer(part, np.uint8).astype(np.int16) - 128
        scan = _scan(levels, row)
        body = b"".join(x for i, s in enumerate(scan) for x in ((s, bytes((0xFF, 0xD0 + i % 8))) if i + 1 < rows else (s,)))
        out.append(_head(len(part), row, rows) + body + b"\xff\xd9")
    return b"".join(out)


# --- decoding -----------------------------------------------------------------------------------------------------


@dataclass
class Picture:
    """What the markers of one file say, and its segments of entropy-coded bytes."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    restart: int = 0
    quant: dict[int, int] = field(default_factory=dict)  # quantiser of the DC level by table
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    tables: dict[int, tuple] = field(default_factory=dict)  # class and slot to (counts, symbols)
    scan: list[tuple[int, int]] = field(default_factory=list)  # of each component: DC and AC slot
    segments: list[bytes] = field(default_factory=list)


def parse(data: bytes) -> list[Picture]:
    """Markers of all pictures in ``data``. Progressive, lossless and arithmetic files are refused."""
    out, i = [], 0
    p = Picture()
    while i < len(data):
        if data[i] != 0xFF:
            raise ValueError(f"no marker at byte {i}")
        kind = data[i + 1]
        if kind == 0xFF:
            i += 1
        elif kind == 0xD8:
            p, i = Picture(), i + 2
        elif kind == 0xD9:
            out.append(p)
            i += 2
        else:
            size = int.from_bytes(data[i + 2 : i + 4], "big")
            body = data[i + 4 : i + 2 + size]
            i += 2 + size
            if kind == 0xFE:
                p.comment = body
            elif kind == 0xDD:
                p.restart = int.from_bytes(body, "big")
            elif kind == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    p.quant[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                    k += 1 + 64 * (1 + wide)
            elif kind == 0xC4:
                k = 0
                while k < len(body):
                    counts = tuple(body[k + 1 : k + 17])
                    p.tables[body[k]] = (counts, tuple(body[k + 17 : k + 17 + sum(counts)]))
                    k += 17 + sum(counts)
            elif kind in (0xC0, 0xC1):
                p.height, p.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                p.components = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            elif 0xC2 <= kind <= 0xCF:
                raise ValueError("not a baseline file")
            elif kind == 0xDA:
                slots = {body[k]: (body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)}
                p.scan = [slots[c[0]] for c in p.components if c[0] in slots]
                end = i
                while True:  # a scan ends at the first marker that is neither a stuffed byte nor a restart
                    end = data.index(b"\xff", end)
                    if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                        end += 2
                    else:
                        break
                raw, start = np.frombuffer(data, np.uint8, end - i, i), 0
                at = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)).tolist() if end > i else []
                for cut in [*at, end - i]:
                    p.segments.append(data[i + start : i + cut].replace(b"\xff\x00", b"\xff"))
                    start = cut + 2
                i = end
    return out


def _layout(p: Picture) -> tuple[list[int], int, int, int]:
    """Component of each block in a unit of the scan, units in a row, units in all, units in a segment."""
    if len(p.components) == 1:
        wide, high, blocks = -(-p.width // 8), -(-p.height // 8), [0]
    else:
        h, v = max(c[1] for c in p.components), max(c[2] for c in p.components)
        wide, high = -(-p.width // (8 * h)), -(-p.height // (8 * v))
        blocks = [k for k, c in enumerate(p.components) for _ in range(c[1] * c[2])]
    return blocks, wide, wide * high, p.restart or wide * high


def _levels(group: list[Picture]) -> list[np.ndarray]:
    """DC levels, a row for each unit and a column for each block in it, of pictures that share tables and layout."""
    p = group[0]
    blocks, _, _, per = _layout(p)
    dc = [lookup(*p.tables[a]) for a, _ in p.scan]
    ac = [lookup(*p.tables[0x10 | b]) for _, b in p.scan]
    flat_ac = [p.tables[0x10 | b][1] == (0,) for _, b in p.scan]
    segments = [s for x in group for s in x.segments]
    units = np.array([min(per, _layout(x)[2] - k * per) for x in group for k in range(len(x.segments))])
    size = np.array([len(s) for s in segments])
    start = np.cumsum(size + 8) - size - 8
    raw = np.frombuffer(b"".join(s + b"\xff" * 8 for s in segments), np.uint8)
    window = raw[:-3].astype(np.uint32) << 24  # the 32 bits from each byte on
    for k in (1, 2, 3):
        window |= raw[k : len(raw) - 3 + k].astype(np.uint32) << (24 - 8 * k)
    pos, stop = start * 8, (start + size) * 8
    pred = np.zeros((len(segments), len(p.components)), np.int32)
    out = np.zeros((len(segments), per, len(blocks)), np.int16)

    def peek(q: np.ndarray, n: int) -> np.ndarray:
        return (window[q >> 3] << (q & 7).astype(np.uint32)) >> np.uint32(32 - n)

    order = np.argsort(-units, kind="stable")
    left = len(order)
    for u in range(per):
        while left and units[order[left - 1]] <= u:
            left -= 1
        live = order[:left] if left < len(order) else slice(None)
        for j, c in enumerate(blocks):
            q = pos[live]
            w = peek(q, 16)
            n, cat = dc[c][1][w], dc[c][0][w].astype(np.int64)
            if not n.all():
                raise ValueError("a code that the table doesn't have")
            q = q + n
            bits = (peek(q, 16) >> (16 - cat).astype(np.uint32)).astype(np.int32)
            diff = np.where(bits < (1 << cat >> 1), bits - (1 << cat) + 1, bits)
            pred[live, c] += diff.astype(np.int32)
            out[live, u, j] = pred[live, c]
            q = q + cat
            if flat_ac[c]:
                q = q + ac[c][1][peek(q, 16)]
            else:
                k, rest = np.ones(len(q), np.int64), np.arange(len(q))
                while len(rest):
                    w = peek(q[rest], 16)
                    n, s = ac[c][1][w].astype(np.int64), ac[c][0][w].astype(np.int64)
                    if not n.all():
                        raise ValueError("a code that the table doesn't have")
                    q[rest] += n + (s & 15)
                    k[rest] = np.where(s == 0, 64, k[rest] + (s >> 4) + 1)
                    rest = rest[k[rest] < 64]
            pos[live] = q
    if (pos > stop).any():
        raise ValueError("a segment ends too early")
    done, k = [], 0
    for x in group:
        done.append(out[k : k + len(x.segments)].reshape(-1, len(blocks))[: _layout(x)[2]])
        k += len(x.segments)
    return done


def thumbnails(pictures: list[Picture]) -> list[np.ndarray]:
    """Luminance of each picture, one 8-bit sample for each 8x8 block, from its DC levels alone."""
    kinds: dict = {}
    for k, p in enumerate(pictures):
        kinds.setdefault((tuple(p.components), tuple(sorted(p.tables.items())), tuple(p.scan), _layout(p)[3]), []).append(k)
    out: list = [None] * len(pictures)
    for members in kinds.values():
        for k, levels in zip(members, _levels([pictures[k] for k in members]), strict=True):
            p = pictures[k]
            blocks, wide, units, _ = _layout(p)
            h, v = (p.components[0][1], p.components[0][2]) if len(p.components) > 1 else (1, 1)
            first = levels[:, [j for j, c in enumerate(blocks) if c == 0]].astype(np.int32)
            grid = first.reshape(units // wide, wide, v, h).transpose(0, 2, 1, 3).reshape(units // wide * v, wide * h)
            grid = grid[: -(-p.height // 8), : -(-p.width // 8)]
            out[k] = np.clip((grid * p.quant[p.components[0][3]] + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    return out


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8x8 reduction are brighter than their mean."""
    ys, xs = (np.arange(9) * n // 8 for n in thumb.shape)
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    total[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    ys, ye = np.minimum(ys[:-1], thumb.shape[0] - 1), np.maximum(ys[1:], ys[:-1] + 1)
    xs, xe = np.minimum(xs[:-1], thumb.shape[1] - 1), np.maximum(xs[1:], xs[:-1] + 1)
    area = (ye - ys)[:, None] * (xe - xs)
    cells = (total[ye][:, xe] - total[ys][:, xe] - total[ye][:, xs] + total[ys][:, xs]) / area
    return np.packbits((cells > cells.mean()).ravel()).tobytes().hex()


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def read_back(media: list[bytes]) -> list[tuple[bytes, str]]:
    """Payload and feature of each stored file: dimensions and thumbnail hash of each of its pictures."""
    parsed = [parse(m) for m in media]
    thumbs = iter(thumbnails([p for x in parsed for p in x]))
    out = []
    for pictures in parsed:
        parts, marks = [], []
        for p in pictures:
            t = next(thumbs)
            parts.append(t.tobytes()[: int(p.comment.split()[1])])
            marks.append(f"{p.width}x{p.height}:{average_hash(t)}")
        out.append((b"".join(parts), ";".join(marks)))
    return out


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Stores each text as a picture, reads it back, and describes both; ``with_media`` keeps the file itself.

    A null text counts as empty, and an empty one is stored as 64 zero bytes. Null ids and repeated rows are kept as
    they are; an empty table gives an empty result; other columns are not read. Long texts make several pictures.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sizes, payloads = zip(*map(payload_of, b.column("text").to_pylist()), strict=True)
            media = [encode(p) for p in payloads]
            back, feature = zip(*read_back(media), strict=True)
            columns = [
                b.column("id"), pa.array(sizes, pa.int64()), pa.array(map(len, back), pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in back]), pa.array([zlib.crc32(p[-UNIT:]) for p in back], pa.int64()),
                pa.array(map(len, media), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(feature),
            ]
            names = ["id", *(x.split()[0] for x in SCHEMA.split(", "))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(media, pa.binary())] * with_media, names + ["media"] * with_media)

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {kind}, {SCHEMA}" + ", media binary" * with_media).withColumnRenamed("id", id_col)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
