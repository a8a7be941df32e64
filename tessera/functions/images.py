"""Image styles and augmentation.

Drawing molecules needs a chemistry or imaging library and stays an interface
(``writers.rendered`` takes the renderer).  What needs neither is here: style presets,
random choices that are the same in every engine and on every retry, and pixel
augmentation in numpy over Arrow batches.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import jpeg


@dataclass(frozen=True)
class Style:
    name: str = "molscribe_default"
    blur: float = 0.2
    noise: float = 0.2
    rotate: float = 0.3
    text_fallback: bool = False

    def __post_init__(self):
        if self.name not in STYLES:
            raise ValueError(f"style {self.name!r} is none of {STYLES}")
        if not all(0 <= p <= 1 for p in (self.blur, self.noise, self.rotate)):
            raise ValueError("probabilities lie between 0 and 1")


#: The names of the styles, and the symbols of condensed formulas.
STYLES = ("molscribe_default", "chemdraw_like")
SYMBOLS = ["C", "H", "O", "N", "S", "P", "F", "Cl", "Br"]


def draw(seed: int, key: Column, k: int) -> Column:
    """The k-th random number in [0, 1) of a row, a function of seed and key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(str(k)))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def condensed_formula(seed: int, key: Column) -> Column:
    """One to four symbols; each may be bracketed with a count and have a count."""
    digit = lambda k: (F.floor(draw(seed, key, k) * 8) + 2).cast("string")
    symbols = F.array(*[F.lit(s) for s in SYMBOLS])
    out, going = None, F.lit(True)
    for i in range(4):
        k = 10 * i
        symbol = F.get(symbols, F.floor(draw(seed, key, k + 1) * len(SYMBOLS)).cast("int"))
        part = F.when(draw(seed, key, k + 2) < 0.25, F.concat(F.lit("("), symbol, digit(k + 3), F.lit(")"))).otherwise(symbol)
        part = F.concat(part, F.when(draw(seed, key, k + 4) < 0.3, digit(k + 5)).otherwise(""))
        going = going if i == 0 else going & (draw(seed, key, k) >= 0.7)
        out = part if out is None else F.concat(out, F.when(going, part).otherwise(""))
    return out


def png(pixels: bytes, width: int, height: int, channels: int = 1) -> bytes:
    """A PNG of grey (1 channel) or colour (3) bytes."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.frombuffer(pixels, np.uint8).reshape(height, width * channels)
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(np.pad(rows, ((0, 0), (1, 0))).tobytes())) + chunk(b"IEND", b"")


def _unfiltered(data: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """A PNG's lines without their filters; ``step``: bytes of a pixel."""
    lines = np.frombuffer(data, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)
    for y, line in enumerate(lines):
        kind, own, above = int(line[0]), line[1:], out[y]
        if kind == 0:
            out[y + 1] = own
        elif kind == 1:
            for c in range(step):
                out[y + 1, c::step] = np.cumsum(own[c::step], dtype=np.uint64)
        elif kind == 2:
            out[y + 1] = own + above
        elif kind in (3, 4):
            row, up, raw = [0] * stride, above.tolist(), own.tolist()
            for x in range(stride):
                a, b, c = row[x - step] if x >= step else 0, up[x], up[x - step] if x >= step else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:  # the one of left, above and above left that is nearest to a + b - c
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                row[x] = raw[x] + guess & 255
            out[y + 1] = row
        else:
            raise ValueError(f"filter {kind} of a PNG")
    return out[1:]


#: An interlaced PNG's passes, as first column and row and steps to the next.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _parts(data: bytes, width: int, height: int, bits: int, channels: int) -> tuple[np.ndarray, int]:
    """The numbers of a PNG's (or a pass's) pixels, of 16 bits the upper 8, and how many bytes they took."""
    stride = -(-width * channels * bits // 8)
    size = height * (stride + 1)
    if len(data) < size:
        raise ValueError("the data of a PNG end early")
    lines = _unfiltered(data[:size], height, stride, max(1, channels * bits // 8))
    if bits == 16:
        lines = lines[:, ::2]
    elif bits < 8:
        each = np.unpackbits(lines, axis=1).reshape(height, -1, bits)
        lines = (each * (1 << np.arange(bits)[::-1])).sum(axis=2)[:, : width * channels]
    return lines.reshape(height, width, channels), size


def decoded_png(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and colour bytes (three for each pixel) of a PNG, of 1 to 16 bits for each
    part, interlaced or not; what is transparent keeps its colour."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, palette, head = 8, b"", None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += size + 12
    width, height, bits, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    body = zlib.decompress(body)
    if interlaced:
        pixels = np.zeros((height, width, channels), np.int64)
        for x, y, dx, dy in _PASSES:
            if width > x and height > y:
                own, size = _parts(body, -(-(width - x) // dx), -(-(height - y) // dy), bits, channels)
                pixels[y::dy, x::dx] = own
                body = body[size:]
    else:
        pixels, _ = _parts(body, width, height, bits, channels)
    if bits < 8 and colour != 3:
        pixels = pixels * 255 // ((1 << bits) - 1)
    pixels = palette[pixels[..., 0]] if colour == 3 else pixels[..., :3] if channels >= 3 else np.repeat(pixels[..., :1], 3, axis=2)
    return width, height, pixels.astype(np.uint8).tobytes()


def decoded(images: DataFrame, image: str) -> DataFrame:
    """``images`` with ``width``, ``height`` and colour bytes ``pixels`` of their PNG or JPEG bytes,
    told apart by their first bytes. Others are an error and need an imaging library."""
    schema = T.StructType([*images.schema.fields, T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.BinaryType())])

    def run(batches):
        for pdf in batches:
            found = [(jpeg.decoded_jpeg if bytes(x[:2]) == b"\xff\xd8" else decoded_png)(bytes(x)) for x in pdf[image]]
            width, height, pixels = zip(*found) if found else ((), (), ())
            yield pdf.assign(width=pd.Series(width, pdf.index, dtype="int32"), height=pd.Series(height, pdf.index, dtype="int32"), pixels=pd.Series(pixels, pdf.index, dtype=object))

    return images.mapInPandas(run, schema)


def encoded(images: DataFrame, pixels: str, width: str, height: str, name: str = "image", channels: int = 1, lossy: bool = False) -> DataFrame:
    """``images`` with PNG bytes of their ``pixels``, or JPEG bytes if ``lossy``."""
    write = jpeg.jpeg if lossy else png
    schema = T.StructType([*images.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{name: pd.Series([write(bytes(p), w, h, channels) for p, w, h in zip(pdf[pixels], pdf[width], pdf[height])], pdf.index, dtype=object)})

    return images.mapInPandas(run, schema)


def chosen_label(rendered: Column, given: Column, training: bool) -> Column:
    """Training learns what was drawn, validation what was asked for."""
    return rendered if training else given


def _blurred(a: np.ndarray, sigma: float) -> np.ndarray:
    x = np.arange(-2, 3)
    w = np.exp(-(x**2) / (2 * sigma**2))
    w /= w.sum()
    for axis in (0, 1):
        padded = np.pad(a, [(2, 2) if k == axis else (0, 0) for k in range(2)], mode="edge")
        a = sum(w[k] * np.take(padded, range(k, k + a.shape[axis]), axis=axis) for k in range(5))
    return a


def _rotated(a: np.ndarray, degrees: float, fill: float) -> np.ndarray:
    t = np.deg2rad(degrees)
    h, w = a.shape
    y, x = np.mgrid[:h, :w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    u = np.rint(np.cos(t) * x + np.sin(t) * y + (w - 1) / 2).astype(int)
    v = np.rint(-np.sin(t) * x + np.cos(t) * y + (h - 1) / 2).astype(int)
    inside = (u >= 0) & (u < w) & (v >= 0) & (v < h)
    return np.where(inside, a[v.clip(0, h - 1), u.clip(0, w - 1)], fill)


def augmented(images: DataFrame, key: str, style: Style, seed: int) -> DataFrame:
    """``images`` (grey bytes ``pixels``, ``width``, ``height``) rotated, blurred and with
    noise, each with its probability; the same for a key in every run."""

    def run(batches):
        for pdf in batches:
            out = []
            for k, pixels, width, height in zip(pdf[key], pdf["pixels"], pdf["width"], pdf["height"]):
                r = np.random.default_rng([seed, int.from_bytes(hashlib.blake2b(str(k).encode(), digest_size=16).digest())])
                a = np.frombuffer(pixels, np.uint8).reshape(height, width).astype(float)
                if r.random() < style.rotate:
                    a = _rotated(a, r.uniform(-5, 5), 255.0)
                if r.random() < style.blur:
                    a = _blurred(a, r.uniform(0.2, 0.8))
                if r.random() < style.noise:
                    a = a + r.normal(0, r.uniform(2, 8), a.shape)
                out.append(a.round().clip(0, 255).astype(np.uint8).tobytes())
            yield pdf.assign(pixels=pd.Series(out, index=pdf.index, dtype=object))

    return images.mapInPandas(run, images.schema)
