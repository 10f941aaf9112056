"""Page images without an image library: size and orientation from the header, and crops of PNG files.

Sizes are read from PNG and JPEG headers, orientation from a JPEG's EXIF block. Crops need the pixels: PNG with 8 bits a channel and without interlacing is read and
written here (its rows are filtered and deflated, which numpy and zlib undo); other kinds are an error that names them, and are left to the caller's client."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np

from ..operators.vision import ImageError

_PNG = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
#: Frame headers of JPEG files that hold the size.
_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}


@dataclass(frozen=True)
class ImageAsset:
    """What is known of a page's image: identity, size, and how its pixels relate to the file's units."""

    page_id: str
    sha256: str
    media_type: str
    width: int
    height: int
    orientation: int = 1
    scale_x: float = 1.0
    scale_y: float = 1.0


@dataclass(frozen=True)
class Crop:
    """A piece of a page image, with the box it was cut from, in pixels of the page."""

    line_id: str
    left: int
    top: int
    right: int
    bottom: int
    media_type: str
    content: bytes

    @property
    def width(self) -> int:
        return self.right - self.left

    @property
    def height(self) -> int:
        return self.bottom - self.top


def orientation(content: bytes) -> int:
    """The EXIF orientation of a JPEG, 1 where there is none."""
    for marker, at, size in _segments(content):
        block = content[at : at + size]
        if marker == 0xE1 and block.startswith(b"Exif\0\0"):
            tiff = block[6:]
            order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
            if order is None or len(tiff) < 8:
                return 1
            first = struct.unpack(order + "I", tiff[4:8])[0]
            entries = struct.unpack(order + "H", tiff[first : first + 2])[0] if len(tiff) >= first + 2 else 0
            for k in range(entries):
                entry = tiff[first + 2 + 12 * k : first + 14 + 12 * k]
                if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 0x0112:
                    value = struct.unpack(order + "H", entry[8:10])[0]
                    return value if 1 <= value <= 8 else 1
            return 1
    return 1


def _segments(content: bytes):
    """(marker, start, length) of a JPEG's segments up to the picture."""
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF:
        marker, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
        if marker == 0xDA:
            return
        yield marker, at + 4, size - 2
        at += 2 + size


def size(content: bytes) -> tuple[str, int, int]:
    """(media type, width, height) as the picture is meant to be seen."""
    if content.startswith(_PNG) and len(content) >= 24:
        return "image/png", *struct.unpack(">II", content[16:24])
    for marker, at, n in _segments(content):
        if marker in _FRAMES and n >= 5:
            height, width = struct.unpack(">HH", content[at + 1 : at + 5])
            return ("image/jpeg", height, width) if orientation(content) >= 5 else ("image/jpeg", width, height)
    raise ImageError("neither PNG nor JPEG")


def asset(page_id: str, content: bytes, page_width: int = 0, page_height: int = 0) -> ImageAsset:
    """The asset of an image; the file's page size, where it is known, gives the scale."""
    kind, width, height = size(content)
    return ImageAsset(page_id, hashlib.sha256(content).hexdigest(), kind, width, height, orientation(content) if kind == "image/jpeg" else 1,
                      width / page_width if page_width > 0 else 1.0, height / page_height if page_height > 0 else 1.0)


def read_png(content: bytes) -> np.ndarray:
    """Rows x columns x channels."""
    if not content.startswith(_PNG):
        raise ImageError("not a PNG file")
    at, data, header = 8, b"", None
    while at + 8 <= len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", content[at + 8 : at + 21])
        elif kind == b"IDAT":
            data += content[at + 8 : at + 8 + n]
        at += 12 + n
    if header is None or header[2] != 8 or header[3] not in _CHANNELS or header[6]:
        raise ImageError("only PNG files with 8 bits a channel, without palette and interlacing, are read")
    width, height, channels = header[0], header[1], _CHANNELS[header[3]]
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height + 1, width + 1, channels), np.uint8)  # a row and a column of zeros before the picture
    for y in range(height):
        line, above = raw[y, 1:].reshape(width, channels), out[y, 1:]
        kind = raw[y, 0]
        if kind in (0, 2):
            out[y + 1, 1:] = line + (above if kind == 2 else 0)
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line, axis=0, dtype=np.uint8)
        else:
            for x in range(width):
                left, up, corner = (out[y + 1, x].astype(int), out[y, x + 1].astype(int), out[y, x].astype(int))
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                out[y + 1, x + 1] = (line[x] + guess) & 255
    return out[1:, 1:]


def write_png(pixels: np.ndarray) -> bytes:
    height, width, channels = pixels.shape
    colour = {v: k for k, v in _CHANNELS.items()}[channels]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], 1).tobytes()
    header = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return _PNG + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def inside(points: list[tuple[float, float]], width: int, height: int) -> np.ndarray:
    """Which pixel centres lie in a polygon (even-odd rule)."""
    y, x = np.mgrid[0:height, 0:width] + 0.5
    out = np.zeros((height, width), bool)
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
        if ay != by:
            crosses = (ay > y) != (by > y)
            out ^= crosses & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return out


def crop(line_id: str, pixels: np.ndarray, box: tuple[int, int, int, int], polygon: list[tuple[float, float]] | None = None) -> Crop:
    """A line's piece of the page; what lies outside the polygon (in pixels of the page) becomes white."""
    left, top, right, bottom = box
    piece = pixels[top:bottom, left:right].copy()
    if not piece.size:
        raise ImageError(f"nothing is left of line {line_id}")
    if polygon:
        shown = inside([(x - left, y - top) for x, y in polygon], piece.shape[1], piece.shape[0])
        piece[~shown] = 255
    return Crop(line_id, left, top, right, bottom, "image/png", write_png(piece))
