"""JPEG files as arrays: sequential and progressive Huffman coding, 8 bits a sample.

Only the entropy-coded bits are followed one by one; dequantizing, the inverse transform,
upsampling and colour conversion are array operations.
"""

from __future__ import annotations

import re
import struct
from array import array
from dataclasses import dataclass, field

import numpy as np

SIGNATURE = b"\xff\xd8\xff"

#: Frames that can be decoded: baseline, extended sequential, progressive.
_FRAMES = (0xC0, 0xC1, 0xC2)
_OTHER_FRAMES = (0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)
#: Blocks that are transformed at a time.
_BLOCKS = 1 << 14


def _zigzag() -> np.ndarray:
    """Places of an 8 by 8 block in the order of the file: anti-diagonals, turning at each."""
    y, x = np.divmod(np.arange(64), 8)
    return np.lexsort((np.where((x + y) % 2, y, x), x + y))


def _cosines() -> np.ndarray:
    k = np.arange(8)
    waves = np.cos((2 * k[:, None] + 1) * k * np.pi / 16) / 2
    waves[:, 0] /= np.sqrt(2)
    return waves


_ORDER, _WAVES = _zigzag(), _cosines()


@dataclass
class _Plane:
    """A component: its sampling, its quantization table and its coefficients, 64 a block."""

    ident: int
    across: int
    down: int
    table: int
    width: int = 0
    height: int = 0
    stride: int = 0
    coefs: array = field(default_factory=lambda: array("h"))


def _segments(content: bytes):
    """(marker, start, end) of the segments from the first on; the bits of scans are passed over."""
    at = 2
    while True:
        at = content.find(b"\xff", at)
        if at < 0 or at + 4 > len(content):
            return
        kind = content[at + 1]
        if kind == 0xD9:
            return
        if kind in (0x00, 0x01, 0xFF) or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        size = int.from_bytes(content[at + 2 : at + 4])
        if size < 2 or at + 2 + size > len(content):
            raise ValueError("a segment is cut off")
        yield kind, at + 4, at + 2 + size
        at += 2 + size
        if kind == 0xDA:
            end = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]").search(content, at)
            at = end.start() if end else len(content)


def jpeg_size(content: bytes) -> tuple[int, int]:
    """(width, height) from the frame header; nothing is decoded."""
    for kind, at, end in _segments(content):
        if kind in _FRAMES or kind in _OTHER_FRAMES:
            height, width = struct.unpack(">HH", content[at + 1 : at + 5])
            if not width or not height:
                raise ValueError("no pixels")
            return width, height
    raise ValueError("no frame")


def _codes(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits that may come: the length of the code at their start times 256, plus its symbol; 0 for none."""
    table, symbol, filled = [0] * 65536, iter(symbols), 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            span = 1 << (16 - length)
            if filled + span > 65536:
                raise ValueError("Huffman codes overflow")
            table[filled : filled + span] = [length << 8 | next(symbol)] * span
            filled += span
    return table


def _places(planes: list[_Plane], width: int, height: int, across: int, down: int):
    """(units of the scan, offsets of unit n as (place in the scan, offset of the block) pairs)."""
    if len(planes) == 1:
        p = planes[0]
        wide, high = -(-p.width // 8), -(-p.height // 8)
        return wide * high, lambda n: [(0, (n // wide * p.stride + n % wide) * 64)]
    wide, high = -(-width // (8 * across)), -(-height // (8 * down))
    blocks = [(i, y, x) for i, p in enumerate(planes) for y in range(p.down) for x in range(p.across)]

    def unit(n: int) -> list[tuple[int, int]]:
        row, col = divmod(n, wide)
        return [(i, ((row * planes[i].down + y) * planes[i].stride + col * planes[i].across + x) * 64) for i, y, x in blocks]

    return wide * high, unit


def _read_scan(bits: bytes, planes: list[_Plane], tables: list[tuple], places, restart: int, first: int, last: int, high: int, low: int) -> None:
    """Adds one scan to the coefficients of its planes; a sequential file is one scan of everything."""
    total, unit = places
    parts = re.split(rb"\xff+[\xd0-\xd7]", bits) if restart else [bits]
    begin, one = max(first, 1), 1 << low
    for part, data in enumerate(parts):
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + bytes(8), np.uint8).astype(np.uint32)
        window = array("I", (raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]).tobytes())  # 32 bits from each byte on
        p, run, before = 0, 0, [0] * len(planes)
        for n in range(part * restart, min(total, (part + 1) * restart) if restart else total):
            for i, base in unit(n):
                out, (dc, ac) = planes[i].coefs, tables[i]
                if first == 0:
                    if high:
                        if window[p >> 3] >> (31 - (p & 7)) & 1:
                            out[base] |= one
                        p += 1
                    else:
                        code = dc[window[p >> 3] >> (16 - (p & 7)) & 65535]
                        if not code:
                            raise ValueError("no such code")
                        p += code >> 8
                        size = code & 31
                        if size:
                            value = (window[p >> 3] >> (16 - (p & 7)) & 65535) >> (16 - size)
                            p += size
                            before[i] += value if value >> (size - 1) else value - (1 << size) + 1
                        out[base] = before[i] << low
                if not last:
                    continue
                k = begin
                if high:  # another bit of what is there, and what appears at this bit
                    while not run and k <= last:
                        code = ac[window[p >> 3] >> (16 - (p & 7)) & 65535]
                        if not code:
                            raise ValueError("no such code")
                        p += code >> 8
                        skip, size, value = code >> 4 & 15, code & 15, 0
                        if size:
                            value = one if window[p >> 3] >> (31 - (p & 7)) & 1 else -one
                            p += 1
                        elif skip < 15:
                            run = (1 << skip) + ((window[p >> 3] >> (16 - (p & 7)) & 65535) >> (16 - skip))
                            p += skip
                            break
                        while k <= last:
                            c = out[base + k]
                            if c:
                                if window[p >> 3] >> (31 - (p & 7)) & 1:
                                    out[base + k] = c + one if c > 0 else c - one
                                p += 1
                            elif skip:
                                skip -= 1
                            else:
                                break
                            k += 1
                        if value and k <= last:
                            out[base + k] = value
                        k += 1
                    if run:
                        run -= 1
                        for k in range(k, last + 1):
                            c = out[base + k]
                            if c:
                                if window[p >> 3] >> (31 - (p & 7)) & 1:
                                    out[base + k] = c + one if c > 0 else c - one
                                p += 1
                    continue
                if run:
                    run -= 1
                    continue
                while k <= last:
                    code = ac[window[p >> 3] >> (16 - (p & 7)) & 65535]
                    p += code >> 8
                    size = code & 15
                    if size:
                        k += code >> 4 & 15
                        if k > last:
                            raise ValueError("a block overflows")
                        value = (window[p >> 3] >> (16 - (p & 7)) & 65535) >> (16 - size)
                        p += size
                        out[base + k] = (value if value >> (size - 1) else value - (1 << size) + 1) << low
                        k += 1
                    elif not code:
                        raise ValueError("no such code")
                    elif code & 240 == 240:
                        k += 16
                    else:
                        skip = code >> 4 & 15
                        run = (1 << skip) + ((window[p >> 3] >> (16 - (p & 7)) & 65535) >> (16 - skip)) - 1
                        p += skip
                        break


def _samples(plane: _Plane, table: np.ndarray) -> np.ndarray:
    """The plane's samples, of its own size."""
    coefs = np.frombuffer(plane.coefs, np.int16).reshape(-1, 64)
    out = np.empty((len(coefs), 8, 8), np.uint8)
    for k in range(0, len(coefs), _BLOCKS):
        natural = np.zeros((min(_BLOCKS, len(coefs) - k), 64))
        natural[:, _ORDER] = coefs[k : k + _BLOCKS] * table
        block = _WAVES @ natural.reshape(-1, 8, 8) @ _WAVES.T
        out[k : k + _BLOCKS] = np.clip(np.rint(block) + 128, 0, 255)
    rows = out.reshape(-1, plane.stride, 8, 8).transpose(0, 2, 1, 3).reshape(-1, plane.stride * 8)
    return rows[: plane.height, : plane.width]


def _enlarged(samples: np.ndarray, across: int, down: int) -> np.ndarray:
    """Samples on the full grid: twofold enlargement weighs the nearer sample by three and the farther by one, other factors repeat."""
    if across != 2 or down > 2:
        return samples.repeat(down, axis=0).repeat(across, axis=1)
    lines = samples.astype(np.int32)
    if down == 2:
        edge = np.pad(lines, ((1, 1), (0, 0)), "edge")
        lines = np.stack([3 * lines + edge[:-2], 3 * lines + edge[2:]], axis=1).reshape(-1, lines.shape[1])
    edge = np.pad(lines, ((0, 0), (1, 1)), "edge")
    left, right, shift = (8, 7, 4) if down == 2 else (1, 2, 2)
    pairs = np.stack([3 * lines + edge[:, :-2] + left >> shift, 3 * lines + edge[:, 2:] + right >> shift], axis=2)
    return pairs.reshape(len(lines), -1).astype(np.uint8)


def _rgb_of(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> list[np.ndarray]:
    """Red, green, blue by the constants of the file format, in 16-bit fractions."""
    y, cb, cr = y.astype(np.int32), cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    shifts = (91881 * cr, -22554 * cb - 46802 * cr, 116130 * cb)
    return [np.clip(y + (s + 32768 >> 16), 0, 255).astype(np.uint8) for s in shifts]


def read_jpeg(content: bytes) -> np.ndarray:
    """An RGBA array of shape (height, width, 4); ValueError or IndexError for what is damaged or of another coding."""
    if not content.startswith(SIGNATURE):
        raise ValueError("no JPEG signature")
    scales, codes, planes, restart, adobe, jfif = {}, {}, [], 0, None, False
    for kind, at, end in _segments(content):
        body = content[at:end]
        if kind == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                scales[body[0] & 15] = np.frombuffer(body, ">u1" if wide == 1 else ">u2", 64, 1).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2])
        elif kind == 0xE0:
            jfif |= body.startswith(b"JFIF")
        elif kind == 0xEE and body.startswith(b"Adobe"):
            adobe = body[11]
        elif kind in _OTHER_FRAMES:
            raise ValueError(f"no decoder for this kind of JPEG ({kind:02X})")
        elif kind in _FRAMES:
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8:
                raise ValueError(f"{depth} bits a sample")
            if not width or not height:
                raise ValueError("no pixels")
            planes = [_Plane(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * n, 3)]
            if n not in (1, 3, 4) or not all(1 <= f <= 4 for p in planes for f in (p.across, p.down)):
                raise ValueError("no such sampling")
            across, down = max(p.across for p in planes), max(p.down for p in planes)
            for p in planes:
                p.width, p.height = -(-width * p.across // across), -(-height * p.down // down)
                p.stride = -(-width // (8 * across)) * p.across
                p.coefs = array("h", bytes(128 * p.stride * -(-height // (8 * down)) * p.down))
        elif kind == 0xDA:
            own, tables = [], []
            for k in range(1, 1 + 2 * body[0], 2):
                own += [p for p in planes if p.ident == body[k]]
                tables.append((codes.get(body[k + 1] >> 4), codes.get(16 + (body[k + 1] & 15))))
            if not own or len(own) != len(tables):
                raise ValueError("a scan without its frame")
            first, last, steps = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            high, low = steps >> 4, steps & 15
            if first > last or last > 63 or low > 13 or any((dc is None and first == 0 and not high) or (ac is None and last) for dc, ac in tables):
                raise ValueError("a scan without its tables")
            stop = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]").search(content, end)
            _read_scan(content[end : stop.start() if stop else len(content)], own, tables, _places(own, width, height, across, down), restart, first, last, high, low)
    if not planes:
        raise ValueError("no frame")
    parts = []
    for p in planes:
        if across % p.across or down % p.down or p.table not in scales:
            raise ValueError("no such sampling")
        parts.append(_enlarged(_samples(p, scales[p.table]), across // p.across, down // p.down)[:height, :width])
    out = np.full((height, width, 4), 255, np.uint8)
    named_rgb = [p.ident for p in planes[:3]] == [82, 71, 66] and not jfif
    mixed = adobe == 2 if len(parts) == 4 else adobe != 0 and not (adobe is None and named_rgb)
    colours = parts[:1] * 3 if len(parts) == 1 else _rgb_of(*parts[:3]) if mixed else parts[:3]
    if len(parts) == 4:  # inks; this program stores them inverted
        inks = [c if adobe is not None else 255 - c for c in (*colours, parts[3])]
        colours = [(c.astype(np.int32) * inks[3] + 127) // 255 for c in inks[:3]]
    out[..., :3] = np.stack(colours, axis=-1)
    return out
