"""Sequential JPEGs of 8 bits: coefficients by Huffman codes, pixels by the inverse cosine
transform.

Codes are read in Python, one lookup each, about a microsecond for a coefficient that isn't
zero; the transform runs in numpy over all blocks of an image. Progressive, arithmetic and
lossless images and those of four colours are a ``ValueError``, as are data that end early.
"""

from __future__ import annotations

import re
import struct

import numpy as np

#: Where the k-th coefficient of a block stands, row by row: along diagonals, in turn up and down.
_ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8, k % 8)[(k // 8 + k % 8 + 1) % 2]))
#: The orthonormal cosine transform of eight values.
_COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) / (2 if u else np.sqrt(8)) for x in range(8)] for u in range(8)])
#: Red, green and blue from luminance and the two differences.
_TO_COLOURS = np.array([[1, 0, 1.402], [1, -0.344136, -0.714136], [1, 1.772, 0]])


def _code(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(length, symbol) by the next 16 bits; length 0 where no code begins so."""
    table: list[tuple[int, int]] = []
    given = iter(symbols)
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table += [(length, next(given))] * (1 << 16 - length)
    if len(table) > 1 << 16:
        raise ValueError("the codes of a JPEG overlap")
    return table + [(0, 0)] * ((1 << 16) - len(table))


def _blocks(data: bytes, order: list[tuple[int, int]], codes: list, out: list[np.ndarray]) -> None:
    """Coefficients of one restart interval's blocks. ``order``: (component, block) in turn;
    ``codes``: each component's codes for the first and the other coefficients."""
    data = data.replace(b"\xff\x00", b"\xff")
    end = 8 * len(data)
    data += b"\0\0\0"
    last = [0] * len(out)
    at = 0

    def number(size: int) -> int:
        """A number of ``size`` bits; the lower half of the range stands for negative ones."""
        k = at >> 3
        bits = (data[k] << 16 | data[k + 1] << 8 | data[k + 2]) >> (24 - size - (at & 7)) & ((1 << size) - 1)
        return bits if bits >> size - 1 else bits - (1 << size) + 1

    for c, block in order:
        first, others = codes[c]
        held, k = {}, 0
        while k < 64:
            if at >= end:
                raise ValueError("the data of a JPEG end early")
            i = at >> 3
            length, symbol = (others if k else first)[(data[i] << 16 | data[i + 1] << 8 | data[i + 2]) >> (8 - (at & 7)) & 65535]
            if not length:
                raise ValueError("no code of a JPEG")
            at += length
            size = symbol & 15
            if at + size > end:
                raise ValueError("the data of a JPEG end early")
            if k == 0:
                last[c] += number(symbol) if symbol else 0
                at += symbol
                held[0] = last[c]
            elif size == 0:
                if symbol != 0xF0:
                    break
                k += 15
            else:
                k += symbol >> 4
                if k > 63:
                    raise ValueError("a block of a JPEG is too long")
                held[_ZIGZAG[k]] = number(size)
                at += size
            k += 1
        out[c][block, list(held)] = list(held.values())


def _stretched(plane: np.ndarray, factor: int, axis: int) -> np.ndarray:
    """A plane with ``factor`` values for each, between the centres of the given ones by line."""
    if factor == 1:
        return plane
    n = plane.shape[axis]
    at = ((np.arange(n * factor) + 0.5) / factor - 0.5).clip(0, n - 1)
    low = np.floor(at).astype(int)
    part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
    return np.take(plane, low, axis) * (1 - part) + np.take(plane, np.minimum(low + 1, n - 1), axis) * part


def decoded_jpeg(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and colour bytes (three for each pixel) of a JPEG. Colours of less
    resolution are interpolated; decoders differ by a step or two in that and in rounding."""
    try:
        return _decoded(data)
    except (KeyError, IndexError, StopIteration, struct.error) as lacking:
        raise ValueError("a JPEG refers to what it lacks") from lacking


def _decoded(data: bytes) -> tuple[int, int, bytes]:
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    steps, codes, every, adobe, parts, seen = {}, {}, 0, None, None, set()
    at = 2
    while at + 4 <= len(data):
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at] != 0xFF:
            raise ValueError("no marker of a JPEG")
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                steps[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], f">u{wide}").astype(np.int64)
                body = body[1 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _code(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            every = int.from_bytes(body[:2], "big")
        elif kind == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif kind in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or n not in (1, 3) or not width or not height:
                raise ValueError("a JPEG of other bits, colours or sizes than are read")
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            most = max(p[1] for p in parts), max(p[2] for p in parts)
            if any(m % f for p in parts for m, f in zip(most, p[1:3])):
                raise ValueError("a JPEG whose colours have no whole ratio of resolutions")
            units = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
            grids = [(units[0] * h, units[1] * v) for _, h, v, _ in parts]
            sizes = [(-(-width * h // most[0]), -(-height * v // most[1])) for _, h, v, _ in parts]
            held = [np.zeros((across * down, 64), np.int64) for across, down in grids]
        elif 0xC2 <= kind <= 0xCF and kind != 0xC8:
            raise ValueError("a JPEG that isn't sequential with Huffman codes")
        elif kind == 0xDA:
            if parts is None:
                raise ValueError("a scan of a JPEG before its sizes")
            names = [p[0] for p in parts]
            own = {names.index(body[1 + 2 * k]): (codes[body[2 + 2 * k] >> 4], codes[16 + (body[2 + 2 * k] & 15)]) for k in range(body[0])}
            if len(own) == 1:  # blocks of one component, without the filling of whole units
                (c,) = own
                across, down = (-(-s // 8) for s in sizes[c])
                turns = [[(c, y * grids[c][0] + x)] for y in range(down) for x in range(across)]
            else:
                turns = [
                    [(c, (y * parts[c][2] + v) * grids[c][0] + x * parts[c][1] + h) for c in own for v in range(parts[c][2]) for h in range(parts[c][1])]
                    for y in range(units[1]) for x in range(units[0])
                ]
            stop = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, at)
            end = stop.start() if stop else len(data)
            pieces = re.split(rb"\xff+[\xd0-\xd7]", data[at:end])
            n = every or len(turns)
            if len(pieces) < -(-len(turns) // n):
                raise ValueError("the data of a JPEG end early")
            for k in range(0, len(turns), n):
                _blocks(pieces[k // n], [b for turn in turns[k : k + n] for b in turn], [own.get(c) for c in range(len(parts))], held)
            seen |= set(own)
            at = end
    if parts is None or len(seen) < len(parts):
        raise ValueError("a JPEG without an image")
    planes = []
    for k, (_, h, v, table) in enumerate(parts):
        weights = np.zeros(64)
        weights[_ZIGZAG] = steps[table]
        across, down = grids[k]
        blocks = _COSINES.T @ (held[k] * weights).reshape(-1, 8, 8) @ _COSINES + 128
        plane = blocks.reshape(down, across, 8, 8).swapaxes(1, 2).reshape(8 * down, 8 * across)
        plane = plane[: sizes[k][1], : sizes[k][0]].round().clip(0, 255)
        planes.append(_stretched(_stretched(plane, most[1] // v, 0), most[0] // h, 1)[:height, :width])
    pixels = np.stack(planes * (3 if len(planes) == 1 else 1), axis=2)
    if len(planes) == 3 and adobe != 0 and [p[0] for p in parts] != list(b"RGB"):
        pixels = (pixels - [0, 128, 128]) @ _TO_COLOURS.T
    return width, height, pixels.round().clip(0, 255).astype(np.uint8).tobytes()


def jpeg(pixels: bytes, width: int, height: int, channels: int = 1, step: int = 1, halved: bool = False, every: int = 0) -> bytes:
    """A JPEG of grey (1 channel) or colour (3) bytes, its coefficients in multiples of ``step``.
    ``halved``: colour differences of half the resolution; ``every``: units between restarts. All
    codes have one length, so that files are some larger than with codes fitted to the image."""
    if not 0 < width < 65536 or not 0 < height < 65536:
        raise ValueError("a JPEG has 1 to 65535 pixels each way")
    given = np.frombuffer(pixels, np.uint8).reshape(height, width, channels).astype(float)
    if channels == 3:
        given = given @ np.linalg.inv(_TO_COLOURS).T + [0, 128, 128]
    most = 2 if halved and channels == 3 else 1
    units = -(-width // (8 * most)), -(-height // (8 * most))
    given = np.pad(given, ((0, 8 * most * units[1] - height), (0, 8 * most * units[0] - width), (0, 0)), mode="edge")
    of = []
    for c in range(channels):
        factor = 1 if c == 0 else most
        plane = given[..., c].reshape(given.shape[0] // factor, factor, given.shape[1] // factor, factor).mean(axis=(1, 3))
        blocks = plane.reshape(plane.shape[0] // 8, 8, plane.shape[1] // 8, 8).swapaxes(1, 2)
        of.append((_COSINES @ (blocks - 128) @ _COSINES.T / step).round().astype(int).reshape(*blocks.shape[:2], 64)[..., _ZIGZAG])
    sizes = list(range(12))
    others = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    body, bits, last = [], [], [0] * channels

    def number(v: int) -> str:
        size = abs(v).bit_length()
        return format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    def flushed() -> bytes:
        text = "".join(bits)
        text += "1" * (-len(text) % 8)
        return int(text or "0", 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")

    for unit in range(units[0] * units[1]):
        if every and unit and unit % every == 0:
            body += [flushed(), bytes([0xFF, 0xD0 + (unit // every - 1) % 8])]
            bits, last = [], [0] * channels
        y, x = divmod(unit, units[0])
        for c in range(channels):
            n = most if c == 0 else 1
            for v, h in ((v, h) for v in range(n) for h in range(n)):
                block = of[c][y * n + v, x * n + h].tolist()
                bits += [format(sizes.index(abs(block[0] - last[c]).bit_length()), "04b"), number(block[0] - last[c])]
                last[c], before = block[0], 0
                for k in [k for k in range(1, 64) if block[k]]:
                    run = k - before - 1
                    bits += [format(1, "08b")] * (run // 16)
                    bits += [format(others.index(run % 16 << 4 | abs(block[k]).bit_length()), "08b"), number(block[k])]
                    before = k
                if before < 63:
                    bits.append(format(0, "08b"))
    body.append(flushed())
    part = lambda kind, held: bytes([0xFF, kind]) + struct.pack(">H", len(held) + 2) + held
    counts = lambda length, n: bytes(n if k == length else 0 for k in range(1, 17))
    head = struct.pack(">BHHB", 8, height, width, channels) + b"".join(bytes([c + 1, 17 * (most if c == 0 else 1), 0]) for c in range(channels))
    return b"".join([
        b"\xff\xd8", part(0xDB, bytes([0]) + bytes([step]) * 64), part(0xC0, head),
        part(0xC4, b"\x00" + counts(4, len(sizes)) + bytes(sizes)), part(0xC4, b"\x10" + counts(8, len(others)) + bytes(others)),
        part(0xDD, struct.pack(">H", every)), part(0xDA, bytes([channels]) + b"".join(bytes([c + 1, 0]) for c in range(channels)) + bytes([0, 63, 0])),
        *body, b"\xff\xd9",
    ])
