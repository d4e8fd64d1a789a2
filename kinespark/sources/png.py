"""PNG images of every kind as arrays: 1 to 16 bits, palettes, transparency, interlacing. Filters that need the pixel before
are undone along diagonals: all pixels of a diagonal at once, as each needs only the two diagonals before. Small images of one
size and kind are undone together."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

MARK = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the format: channels by colour type, and the interlaced passes as first x, first y, step x, step y.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Bytes of lines that are undone together, at least one image's.
STACK = 1 << 20


@dataclass(frozen=True)
class Image:
    """samples: height x width x channels, as written (palette images: indices)."""

    samples: np.ndarray
    bits: int
    colour: int
    palette: np.ndarray | None
    transparent: bytes | None


def _chunks(data: bytes) -> dict[bytes, bytes]:
    if data[:8] != MARK:
        raise ValueError("not a PNG")
    found: dict[bytes, list[bytes]] = {}
    at = 8
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
        found.setdefault(kind, []).append(data[at + 8 : at + 8 + size])
        at += size + 12
        if kind == b"IEND":
            break
    if len(found.get(b"IHDR", [b""])[0]) != 13 or b"IDAT" not in found:
        raise ValueError("PNG without header or pixels")
    return {k: b"".join(v) for k, v in found.items()}


def unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """rows: a filter byte and the bytes of a line each, of one image or of a stack of images; step: bytes from a pixel to the
    next. The lines' bytes."""
    if rows.ndim == 2:
        return unfilter(rows[None], step)[0]
    kinds, one = rows[:, :, 0], rows.shape[2] - 1 == step
    if kinds.max(initial=0) > 4:
        raise ValueError("PNG with an unknown filter")
    hard = np.isin(kinds, (3, 4)).any(axis=1) & (not one)
    if hard.all():
        return _along_diagonals(rows, step)
    out = np.empty((*rows.shape[:2], rows.shape[2] - 1), np.uint8)
    for k in np.nonzero(~hard)[0]:
        out[k] = _by_lines(rows[k], step)
    if hard.any():
        out[hard] = _along_diagonals(rows[hard], step)
    return out


def _by_lines(rows: np.ndarray, step: int) -> np.ndarray:
    """An image without filters 3 and 4, or of one column."""
    kinds, n = rows[:, 0], (rows.shape[1] - 1) // step
    out = rows[:, 1:].copy()
    for y in np.nonzero(kinds)[0]:
        if kinds[y] == 1:
            out[y] = np.cumsum(out[y].reshape(n, step), axis=0, dtype=np.uint8).reshape(-1)
        elif y and kinds[y] != 3:  # also 4 where a line is one pixel, as nothing is at its left
            out[y] += out[y - 1]
        elif y:
            out[y] += out[y - 1] >> 1
    return out


def _along_diagonals(rows: np.ndarray, step: int) -> np.ndarray:
    """A stack of images with any filters."""
    count, height, n = len(rows), rows.shape[1], (rows.shape[2] - 1) // step
    # pixels first, so that a diagonal is a slice of stride n - 1 and the two before it lie in order of lines; channels of all images last
    lines = rows[:, :, 1:].reshape(count, height * n, step).transpose(1, 0, 2).reshape(height * n, count * step).astype(np.int16)
    kinds = np.repeat(rows[:, :, 0].T, step, axis=1)
    before, last, own = (np.zeros((height + 1, count * step), np.int16) for _ in range(3))  # at 1 + line; 0: above the image
    is_left, is_up, is_mean = ((kinds == k).astype(np.int16) for k in (1, 2, 3))
    is_best, plain = kinds == 4, kinds != 4
    some = {k: bool((kinds == k).any()) for k in range(5)}
    for d in range(n + height - 1):
        lo, hi = max(0, d - n + 1), min(height, d + 1)
        at = slice(d + lo * (n - 1), d + (hi - 1) * (n - 1) + 1, max(1, n - 1))
        left, up, corner = last[lo + 1 : hi + 1], last[lo:hi], before[lo:hi]
        value = lines[at].copy()
        if some[3]:
            value += ((left + up) >> 1) * is_mean[lo:hi]
        if some[1]:
            value += left * is_left[lo:hi]
        if some[2]:
            value += up * is_up[lo:hi]
        if some[4]:
            over_up, over_left = up - corner, left - corner
            far, by_left, by_up = np.abs(over_up + over_left), np.abs(over_up), np.abs(over_left)
            best = np.where(by_left <= np.minimum(by_up, far), left, np.where(by_up <= far, up, corner))
            value += best if not plain.any() else best * is_best[lo:hi]
        value &= 255
        own[lo + 1 : hi + 1] = value
        lines[at] = value
        before, last, own = last, own, before
    return lines.reshape(height * n, count, step).transpose(1, 0, 2).reshape(count, height, -1).astype(np.uint8)


def _lines(body: memoryview, width: int, height: int, bits: int, channels: int) -> np.ndarray:
    """The lines of one pass, with their filters."""
    line = (width * channels * bits + 7) // 8
    if len(body) < height * (line + 1):
        raise ValueError("PNG ends early")
    rows = np.frombuffer(body[: height * (line + 1)], np.uint8).reshape(height, line + 1)
    if rows[:, 0].max(initial=0) > 4:
        raise ValueError("PNG with an unknown filter")
    return rows


def _samples(rows: np.ndarray, width: int, bits: int, channels: int) -> np.ndarray:
    """Samples of lines (of one pass, or of a stack of images)."""
    raw = unfilter(rows, max(1, channels * bits // 8))
    ahead = raw.shape[:-1]
    if bits == 16:
        samples = raw.reshape(*ahead, -1, 2).astype(np.uint16)
        samples = samples[..., 0] << 8 | samples[..., 1]
    elif bits == 8:
        samples = raw
    else:
        ones = np.unpackbits(raw, axis=-1).reshape(*ahead, -1, bits)
        samples = (ones << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=-1, dtype=np.uint8)
    return samples[..., : width * channels].reshape(*ahead, width, channels)


def _opened(data: bytes) -> tuple[tuple[int, int, int, int], np.ndarray, bool, np.ndarray | None, bytes | None]:
    """Width, height, bits and colour; lines, or samples where the image is interlaced, and whether it is; palette, transparency."""
    chunks = _chunks(data)
    head = chunks[b"IHDR"]
    width, height, bits, colour, interlaced = int.from_bytes(head[:4]), int.from_bytes(head[4:8]), head[8], head[9], head[12]
    if colour not in CHANNELS or bits not in (1, 2, 4, 8, 16) or not width or not height or interlaced > 1 or (colour != 0 and bits < 8 and colour != 3) or (colour == 3 and bits == 16):
        raise ValueError("PNG of an unknown kind")
    channels = CHANNELS[colour]
    try:
        body = memoryview(zlib.decompress(chunks[b"IDAT"]))
    except zlib.error as e:
        raise ValueError("PNG with broken pixels") from e
    if not interlaced:
        found = _lines(body, width, height, bits, channels)
    else:
        found = np.zeros((height, width, channels), np.uint16 if bits == 16 else np.uint8)
        for x, y, dx, dy in PASSES:
            w, h = -(-(width - x) // dx), -(-(height - y) // dy)
            if w > 0 and h > 0:
                rows = _lines(body, w, h, bits, channels)
                found[y::dy, x::dx] = _samples(rows, w, bits, channels)
                body = body[rows.size :]
    palette = chunks.get(b"PLTE")
    if colour == 3 and not palette:
        raise ValueError("PNG without its palette")
    return (width, height, bits, colour), found, bool(interlaced), np.frombuffer(palette[: len(palette) // 3 * 3], np.uint8).reshape(-1, 3) if palette else None, chunks.get(b"tRNS")


def decode_each(contents: Iterable) -> Iterator:
    """An Image for each of contents, in order, or the ValueError for what is no whole PNG; what isn't bytes comes out as it is.
    Of the images at hand (``STACK``), those of one size and kind are undone together."""
    waiting, size = [], 0

    def undone() -> Iterator:
        alike: dict[tuple, list[int]] = {}
        for k, item in enumerate(waiting):
            if isinstance(item, tuple) and not item[2]:
                alike.setdefault(item[0], []).append(k)
        samples = {}
        for (width, _, bits, colour), places in alike.items():
            stack = _samples(np.stack([waiting[k][1] for k in places]), width, bits, CHANNELS[colour])
            samples |= zip(places, stack, strict=True)
        for k, item in enumerate(waiting):
            yield Image(samples.get(k, item[1]), item[0][2], item[0][3], *item[3:]) if isinstance(item, tuple) else item

    for data in contents:
        if isinstance(data, bytes | bytearray | memoryview):
            try:
                waiting.append(_opened(bytes(data)))
                size += waiting[-1][1].size
            except ValueError as e:
                waiting.append(e)
        else:
            waiting.append(data)
        if size >= STACK:
            yield from undone()
            waiting, size = [], 0
    yield from undone()


def decode(data: bytes) -> Image:
    """ValueError for what is no whole PNG."""
    image = next(decode_each([data]))
    if isinstance(image, ValueError):
        raise image
    return image


def first_channel(data: bytes) -> np.ndarray:
    """The first channel; colours of 16 bits by their high byte, palette images as indices."""
    image = decode(data)
    first = image.samples[:, :, 0]
    return (first >> 8).astype(np.uint8) if image.bits == 16 and image.colour != 0 else first


def rgba(data: bytes) -> np.ndarray:
    """Height x width x 4 bytes: grey as three equal channels, narrow samples widened to 0 .. 255, wide ones by their high
    byte, palettes looked up, alpha 255 but where the image tells otherwise."""
    return coloured(decode(data))


def coloured(image: Image) -> np.ndarray:
    """``rgba`` of an image."""
    s, clear = image.samples, image.transparent
    out = np.full((*s.shape[:2], 4), 255, np.uint8)
    if image.colour == 3:
        table = np.full((256, 4), 255, np.uint8)
        table[:, :3] = 0
        table[: len(image.palette[:256]), :3] = image.palette[:256]
        if clear:
            table[: len(clear[:256]), 3] = np.frombuffer(clear[:256], np.uint8)
        return table[s[:, :, 0]]
    wide = (s >> 8).astype(np.uint8) if image.bits == 16 else s * np.uint8(255 // ((1 << image.bits) - 1))
    colours = 1 if image.colour in (0, 4) else 3
    out[:, :, :3] = wide[:, :, :colours]
    if image.colour in (4, 6):
        out[:, :, 3] = wide[:, :, -1]
    elif clear and len(clear) >= 2 * colours:
        hidden = np.frombuffer(clear[: 2 * colours], ">u2")
        out[:, :, 3][(s == hidden).all(axis=2)] = 0
    return out
