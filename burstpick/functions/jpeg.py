"""A decoder of baseline JPEG files in numpy, for workers without an image library. Others (``cv2.imdecode``, Pillow) can be given
to the analysis in its place; progressive files need one."""

from __future__ import annotations

import re
from array import array

import numpy as np

#: Places of a block's 64 coefficients in the order of the file: along the diagonals, up and down by turns.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) * (1 if (i // 8 + i % 8) % 2 else -1)))
_END_OF_SCAN, _RESTART = re.compile(b"\xff+[^\x00\xd0-\xd7\xff]"), re.compile(b"\xff[\xd0-\xd7]")
#: Rows are frequencies, columns places.
_COSINES = np.cos(np.outer(np.arange(8), 2 * np.arange(8) + 1) * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)[:, None]


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For every 16 bits that may come next: the length of the code they begin with, times 256, and its symbol."""
    table, at, code = [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            table[code << (16 - length) : (code + 1) << (16 - length)] = [length << 8 | symbol] * (1 << (16 - length))
            code += 1
        at, code = at + n, code << 1
    return table


def _coefficients(part: bytes, units: list[list[tuple]], tables: dict) -> None:
    """Decodes one stretch without restarts. A unit lists its blocks: (coefficients to fill, component, DC and AC table)."""
    raw = np.frombuffer(part.replace(b"\xff\x00", b"\xff") + b"\xff" * 8, np.uint8).astype(np.int64)
    ahead = array("q", (raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]).tobytes())  # 32 bits from each byte on
    p, before = 0, {}

    def value(size: int) -> int:
        nonlocal p
        v = ahead[p >> 3] >> (32 - (p & 7) - size) & ((1 << size) - 1)
        p += size
        return v if v >> (size - 1) else v - (1 << size) + 1

    for unit in units:
        for block, component, dc, ac in unit:
            dc, ac = tables[0, dc], tables[1, ac]
            code = dc[ahead[p >> 3] >> (16 - (p & 7)) & 0xFFFF]
            if not code:
                raise ValueError("no such code")
            p += code >> 8
            before[component] = before.get(component, 0) + (value(code & 255) if code & 255 else 0)
            block[0] = before[component]
            k = 1
            while k < 64:
                code = ac[ahead[p >> 3] >> (16 - (p & 7)) & 0xFFFF]
                if not code:
                    raise ValueError("no such code")
                p += code >> 8
                run, size = code >> 4 & 15, code & 15
                if size:
                    k += run
                    block[ZIGZAG[k]] = value(size)
                elif run < 15:
                    break
                else:
                    k += 15
                k += 1


def _decode(data: bytes) -> np.ndarray:
    at, quant, tables, restart, planes, transform = 2, {}, {}, 0, None, 1
    while data[at + 1] != 0xD9:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xEE and body[:5] == b"Adobe":
            transform = body[11]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            if marker > 0xC1 or body[0] != 8:
                raise ValueError("not a baseline file")
            high, wide = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            most_x, most_y = max(p[1] for p in parts), max(p[2] for p in parts)
            units_x, units_y = -(-wide // (8 * most_x)), -(-high // (8 * most_y))
            planes = {c: (np.zeros((units_y * y, units_x * x, 64), np.int32), x, y, q) for c, x, y, q in parts}
        elif marker == 0xDA:
            end = _END_OF_SCAN.search(data, at)
            end = end.start() if end else len(data)
            told = [(body[i], body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
            units = []
            if len(told) == 1:  # block by block, without those that only fill up units
                c, dc, ac = told[0]
                plane, x, y, _ = planes[c]
                across, down = -(-(-(-wide * x // most_x)) // 8), -(-(-(-high * y // most_y)) // 8)
                units = [[(plane[r, s], c, dc, ac)] for r in range(down) for s in range(across)]
            else:
                for r in range(units_y):
                    for s in range(units_x):
                        unit = []
                        for c, dc, ac in told:
                            plane, x, y, _ = planes[c]
                            unit += [(plane[r * y + j, s * x + i], c, dc, ac) for j in range(y) for i in range(x)]
                        units.append(unit)
            for n, part in enumerate(_RESTART.split(data[at:end])):
                _coefficients(part, units[n * restart : (n + 1) * restart] if restart else units, tables)
            at = end
    channels = []
    for plane, x, y, q in planes.values():
        scaled = np.zeros(plane.shape, np.float64)
        scaled[..., ZIGZAG] = plane[..., ZIGZAG] * quant[q]
        rows, cols = plane.shape[:2]
        pixels = _COSINES.T @ scaled.reshape(rows, cols, 8, 8) @ _COSINES
        pixels = pixels.transpose(0, 2, 1, 3).reshape(8 * rows, 8 * cols) + 128
        channels.append(pixels.repeat(most_y // y, 0).repeat(most_x // x, 1)[:high, :wide])
    if len(channels) == 1:
        rgb = np.repeat(channels[0][..., None], 3, 2)
    elif transform:
        luma, blue, red = channels[0], channels[1] - 128, channels[2] - 128
        rgb = np.stack([luma + 1.402 * red, luma - 0.344136 * blue - 0.714136 * red, luma + 1.772 * blue], 2)
    else:
        rgb = np.stack(channels, 2)
    return np.clip(np.round(rgb), 0, 255).astype(np.uint8)


def decode_jpeg(data: bytes | None) -> np.ndarray | None:
    """RGB pixels; None where ``data`` is no baseline JPEG file of one or three channels, or is damaged."""
    if not data or data[:2] != b"\xff\xd8":
        return None
    try:
        return _decode(bytes(data))
    except (ValueError, IndexError, KeyError, TypeError, UnboundLocalError):
        return None
