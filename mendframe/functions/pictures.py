"""Reading and writing pictures without a decoder library: sizes, modes, pixels, errors, and the entropy of grey values.

PNG, GIF, BMP, uncompressed TIFF and sequential JPEG are decoded whole. Of progressive JPEGs the first scan is read; their
grey values are the means of 8 x 8 blocks, the picture at an eighth of its size. Pictures that break off count as read,
as far as they go. WebP, HEIF, AVIF and JPEG 2000 have no reader here. PNG, BMP, TIFF and JPEG can be written.
"""
from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np

from mendframe.functions import jpeg_tables as J
from mendframe.functions import kinds as K


class Broken(ValueError):
    """A picture that can't be read, with the reason."""


@dataclass
class Picture:
    """What a reader finds; pixels (height, width, channels) where it decodes them."""

    width: int
    height: int
    mode: str
    decoded_format: str
    grey: np.ndarray
    pixels: np.ndarray | None = None

    @property
    def entropy(self) -> float:
        """Shannon entropy in bits of the histogram of grey values."""
        counts = np.bincount(self.grey.ravel(), minlength=256)
        share = counts[counts > 0] / max(1, self.grey.size)
        return float(-(share * np.log2(share)).sum()) + 0.0


def need(rule: object, error: str) -> None:
    if not rule:
        raise Broken(error)


def greys(pixels: np.ndarray) -> np.ndarray:
    """Luma of the first three channels, or the first channel, with weights 0.299, 0.587 and 0.114 in 16 bits."""
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    r, g, b = (pixels[:, :, i].astype(np.int64) for i in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16).astype(np.uint8)


# PNG

CHANNELS = {0: (1, "L"), 2: (3, "RGB"), 3: (1, "P"), 4: (2, "LA"), 6: (4, "RGBA")}


def unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of a PNG's decompressed data; missing bytes are zero."""
    data = np.frombuffer(raw[: height * (stride + 1)].ljust(height * (stride + 1), b"\0"), np.uint8).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, row = int(data[y, 0]), data[y, 1:]
        if kind == 1:
            for c in range(step):
                out[y, c::step] = np.cumsum(row[c::step], dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            out[y] = row + above
        elif kind in (3, 4):
            line, up, coded = [0] * (stride + step), [0] * step + above.tolist(), row.tolist()
            for x, value in enumerate(coded):
                left, over, corner = line[x], up[x + step], up[x]
                if kind == 3:
                    guess = (left + over) >> 1
                else:
                    guess = min((abs(over - corner), 0, left), (abs(left - corner), 1, over), (abs(left + over - 2 * corner), 2, corner))[2]
                line[x + step] = (value + guess) & 255
            out[y] = line[step:]
        else:
            need(kind == 0, f"unknown filter {kind} in row {y}")
            out[y] = row
        above = out[y]
    return out


def read_png(data: bytes) -> Picture:
    at, header, palette, coded = 8, None, b"", []
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body, check = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        whole = len(check) == 4
        if kind in (b"IHDR", b"PLTE", b"IDAT"):
            need(not whole or zlib.crc32(kind + body) == int.from_bytes(check, "big"), f"bad checksum of chunk {kind.decode()}")
        if header is None:
            need(kind == b"IHDR" and len(body) == 13, "no header chunk")
            header = struct.unpack(">IIBBBBB", body)
        palette = body if kind == b"PLTE" else palette
        coded += [body] if kind == b"IDAT" else []
        if kind == b"IEND" or not whole:
            break
        at += 12 + size
    need(header, "no header chunk")
    width, height, depth, colour, _, _, interlaced = header
    need(width and height and colour in CHANNELS and depth in (1, 2, 4, 8, 16), "bad header chunk")
    need(coded, "no image data")
    channels, mode = CHANNELS[colour]
    stride = (width * channels * depth + 7) // 8
    need(height * (stride + 1) < 1 << 31, "size beyond what a blob can hold")
    try:
        raw = zlib.decompressobj().decompress(b"".join(coded), height * (stride + 1 + 8))
    except zlib.error as error:
        raise Broken(f"image data: {error}") from error
    if interlaced:  # rows of seven passes: read as one row for the histogram
        return Picture(width, height, mode, "PNG", np.frombuffer(raw or b"\0", np.uint8))
    rows = unfiltered(raw, height, stride, max(1, channels * depth // 8))
    if depth < 8:
        shifts = np.arange(8 - depth, -1, -depth)
        values = (rows[:, :, None] >> shifts & (1 << depth) - 1).reshape(height, -1)[:, :width]
        pixels = (values if colour == 3 else values * (255 // ((1 << depth) - 1))).astype(np.uint8)[:, :, None]
    else:
        pixels = rows.reshape(height, width, channels, depth // 8)[:, :, :, 0]
    if colour == 3:
        table = np.frombuffer(palette.ljust(768, b"\0")[:768], np.uint8).reshape(256, 3)
        pixels = table[pixels[:, :, 0]]
    return Picture(width, height, "1" if depth == 1 and colour == 0 else mode, "PNG", greys(pixels), pixels)


# GIF


def lzw(data: bytes, least: int, most: int) -> bytes:
    """The first `most` values of GIF's variable-length codes, as far as they go."""
    clear, end = 1 << least, (1 << least) + 1
    table = [bytes([i]) for i in range(clear)] + [b"", b""]
    out, size, held, bits, width, last = [], 0, 0, 0, least + 1, b""
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code, held, bits = held & (1 << width) - 1, held >> width, bits - width
            if code == clear:
                del table[end + 1 :]
                width, last = least + 1, b""
                continue
            if code == end or size >= most:
                return b"".join(out)[:most]
            need(code < len(table) + bool(last), "bad code in image data")
            entry = table[code] if code < len(table) else last + last[:1]
            out.append(entry)
            size += len(entry)
            if last and len(table) < 4096:
                table.append(last + entry[:1])
                width = min(12, max(width, len(table).bit_length()))
            last = entry
    return b"".join(out)[:most]


def read_gif(data: bytes) -> Picture:
    need(len(data) >= 13, "header is cut off")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    need(width and height, "empty screen")
    at, table = 13, b""
    if flags & 0x80:
        size = 3 << (flags & 7) + 1
        table, at = data[at : at + size], at + size
    while at < len(data) and data[at] != 0x2C:
        need(data[at] == 0x21, "no image in the file")
        at += 2
        while at < len(data) and data[at]:
            at += 1 + data[at]
        at += 1
    need(at + 10 < len(data), "no image in the file")
    across, down, local = struct.unpack("<HHB", data[at + 5 : at + 10])
    at += 10
    if local & 0x80:
        size = 3 << (local & 7) + 1
        table, at = data[at : at + size], at + size
    need(at < len(data) and 1 < data[at] < 12 or data[at : at + 1] == b"\x01", "bad code size")
    least, blocks, at = data[at], [], at + 1
    while at < len(data) and data[at]:
        blocks.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    values = np.frombuffer(lzw(b"".join(blocks), least, across * down).ljust(across * down, b"\0"), np.uint8)
    colours = np.frombuffer(table.ljust(768, b"\0")[:768], np.uint8).reshape(256, 3)
    pixels = colours[values].reshape(down, across, 3)
    if local & 0x40:  # rows come in four passes
        order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, down, step)]
        rows = np.empty_like(pixels)
        rows[order] = pixels
        pixels = rows
    return Picture(width, height, "P", "GIF", greys(pixels), pixels)


# BMP and TIFF


def read_bmp(data: bytes) -> Picture:
    need(len(data) >= 54, "header is cut off")
    begin, size, width, height, _, depth, packed = struct.unpack("<I4xIiiHHI", data[10:14] + data[:4] + data[14:34])
    need(size >= 40 and width > 0 and height, "bad header")
    need(depth in (8, 24, 32) and packed in (0, 3), f"depth {depth} with compression {packed} is not read")
    stride, rows = (width * depth // 8 + 3) // 4 * 4, abs(height)
    need(stride * rows < 1 << 31, "size beyond what a blob can hold")
    body = np.frombuffer(data[begin : begin + stride * rows].ljust(stride * rows, b"\0"), np.uint8).reshape(rows, stride)
    pixels = body[:, : width * depth // 8].reshape(rows, width, depth // 8)[:: -1 if height > 0 else 1]
    if depth == 8:
        table = np.frombuffer(data[14 + size : begin].ljust(1024, b"\0")[:1024], np.uint8).reshape(256, 4)
        pixels = table[pixels[:, :, 0]]
    pixels = np.ascontiguousarray(pixels[:, :, 2::-1])
    return Picture(width, rows, "P" if depth == 8 else "RGB", "BMP", greys(pixels), pixels)


def read_tiff(data: bytes) -> Picture:
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(order + "I", data[4:8].ljust(4, b"\0"))[0]
    need(8 <= at <= len(data) - 2, "no directory")
    tags = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        if len(entry) < 12:
            break
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        form, each = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, ("", 0))
        if form and count <= len(data) // each:
            offset = struct.unpack(order + "I", entry[8:])[0]
            raw = entry[8 : 8 + each * count] if each * count <= 4 else data[offset : offset + each * count]
            if len(raw) == each * count:
                tags[tag] = struct.unpack(f"{order}{count}{form}", raw)
    width, height = tags.get(256, (0,))[0], tags.get(257, (0,))[0]
    need(width and height and 273 in tags, "no picture in the directory")
    depth, samples, packed = tags.get(258, (1,))[0], tags.get(277, (1,))[0], tags.get(259, (1,))[0]
    need(packed == 1 and depth == 8 and samples in (1, 3, 4), f"depth {depth} with compression {packed} is not read")
    need(width * height * samples < 1 << 31, "size beyond what a blob can hold")
    body = b"".join(data[a : a + n] for a, n in zip(tags[273], tags.get(279, (len(data),) * len(tags[273]))))
    size = width * height * samples
    pixels = np.frombuffer(body[:size].ljust(size, b"\0"), np.uint8).reshape(height, width, samples)
    return Picture(width, height, {1: "L", 3: "RGB", 4: "RGBA"}[samples], "TIFF", greys(pixels), pixels)


# JPEG


@dataclass
class Frame:
    width: int
    height: int
    progressive: bool
    readable: bool
    parts: dict[int, tuple[int, int, int]]  # component: samples across, samples down, number of its table


@dataclass
class Tables:
    steps: dict[int, list[int]] = field(default_factory=dict)  # table number: steps in the order of diagonals
    codes: dict[int, dict] = field(default_factory=dict)  # class and number: (length, code) -> value
    restart: int = 0
    plain_rgb: bool = False


ZIGZAG = J.zigzag()
#: row u holds the values of the u-th cosine at 8 places
COSINES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def huffman_codes(body: bytes) -> dict[int, dict]:
    """Codes of each table in a segment: (length, code) -> value."""
    out, at = {}, 0
    while at + 17 <= len(body):
        number, counts = body[at], body[at + 1 : at + 17]
        values, codes, code, k = body[at + 17 : at + 17 + sum(counts)], {}, 0, 0
        need(len(values) == sum(counts), "a Huffman table is cut off")
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                codes[length, code] = values[k]
                code, k = code + 1, k + 1
            code <<= 1
        out[number], at = codes, at + 17 + len(values)
    return out


@lru_cache(maxsize=64)
def lookup(codes: tuple[tuple[tuple[int, int], int], ...]) -> list[tuple[int, int]]:
    """For each 16 bits the length and value of the code that they begin with; length 17 where there is none."""
    out = [(17, 0)] * 65536
    for (length, code), value in codes:
        first, n = code << 16 - length, 1 << 16 - length
        out[first : first + n] = [(length, value)] * n
    return out


class Bits:
    """Bits of coded data, without stuffed bytes."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.left = data.replace(b"\xff\0", b"\xff"), 0, 0, 0

    def fill(self) -> None:
        """Takes up six more bytes, or what there is."""
        more = self.data[self.at : self.at + 6]
        self.at += len(more)
        self.held = (self.held & (1 << self.left) - 1) << 8 * len(more) | int.from_bytes(more, "big")
        self.left += 8 * len(more)

    def value(self, table: list[tuple[int, int]]) -> int:
        if self.left < 16:
            self.fill()
        peek = self.held >> self.left - 16 if self.left >= 16 else self.held << 16 - self.left
        length, value = table[peek & 65535]
        if length > self.left:
            raise EOFError  # no such code, or no more data: what follows can't be read
        self.left -= length
        return value

    def signed(self, size: int) -> int:
        if not size:
            return 0
        if self.left < size:
            self.fill()
            if self.left < size:
                raise EOFError
        self.left -= size
        bits = self.held >> self.left & (1 << size) - 1
        return bits if bits >> size - 1 else bits - (1 << size) + 1


class Coefficients:
    """Dequantised coefficients of all blocks of a frame, by component; blocks that no data reach stay zero, mid-grey."""

    def __init__(self, frame: Frame) -> None:
        self.frame = frame
        self.widest, self.tallest = (max(p[i] for p in frame.parts.values()) for i in (0, 1))
        self.units = -(-frame.width // (8 * self.widest)), -(-frame.height // (8 * self.tallest))
        need(self.units[0] * self.units[1] * sum(a * b for a, b, _ in frame.parts.values()) < 1 << 24, "size beyond what a blob can hold")
        self.blocks = {n: np.zeros((self.units[1] * b, self.units[0] * a, 64), np.int32) for n, (a, b, _) in frame.parts.items()}

    def places(self, parts: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
        """The blocks (place in parts, row, column) of each unit of a scan, in coded order."""
        if len(parts) == 1:
            across, down, _ = self.frame.parts[parts[0][0]]
            wide, high = -(-self.frame.width * across // (8 * self.widest)), -(-self.frame.height * down // (8 * self.tallest))
            yield from ([(0, y, x)] for y in range(high) for x in range(wide))
            return
        for uy in range(self.units[1]):
            for ux in range(self.units[0]):
                yield [(i, uy * self.frame.parts[n][1] + v, ux * self.frame.parts[n][0] + h) for i, (n, _, _) in enumerate(parts) for v in range(self.frame.parts[n][1]) for h in range(self.frame.parts[n][0])]

    def decode(self, tables: Tables, scan: bytes, parts: list[tuple[int, int, int]], only_means: bool, shift: int) -> None:
        """Fills in the blocks of a scan, as far as its data go."""
        pieces, at = [], 0
        for mark in RESTARTS.finditer(scan):
            pieces.append(scan[at : mark.start()])
            at = mark.end()
        pieces.append(scan[at:])
        looks = {n: lookup(tuple(tables.codes[n].items())) for _, means, others in parts for n in (means, 0x10 | others) if n in tables.codes}
        units = self.places(parts)
        for piece in pieces:
            bits, held = Bits(piece), [0] * len(parts)
            todo = islice(units, tables.restart) if tables.restart else units
            for unit in todo:
                try:
                    for i, y, x in unit:
                        number, means, others = parts[i]
                        steps, block = tables.steps[self.frame.parts[number][2]], [0] * 64
                        held[i] += bits.signed(bits.value(looks[means])) << shift
                        block[0] = held[i] * steps[0]
                        k = 1
                        while k < 64 and not only_means:
                            value = bits.value(looks[0x10 | others])
                            if not value & 15 and value != 0xF0:
                                break
                            k += value >> 4
                            if value & 15 and k < 64:
                                block[ZIGZAG[k]] = bits.signed(value & 15) * steps[k]
                            k += 1
                        self.blocks[number][y, x] = np.clip(block, -(1 << 20), 1 << 20)
                except EOFError:
                    break
            for _ in todo if tables.restart else ():
                pass  # what a broken piece leaves out keeps its place

    def plane(self, number: int) -> np.ndarray:
        """Values of a component, at its own size."""
        blocks = self.blocks[number]
        values = np.einsum("uy,abuv,vx->aybx", COSINES, blocks.reshape(*blocks.shape[:2], 8, 8).astype(np.float64), COSINES, optimize=True)
        return np.clip(np.rint(values.reshape(blocks.shape[0] * 8, blocks.shape[1] * 8) + 128), 0, 255).astype(np.uint8)

    def pixels(self, plain_rgb: bool) -> np.ndarray:
        """Pixels of one or three channels, parts of fewer samples spread out."""
        planes = []
        for number, (across, down, _) in self.frame.parts.items():
            own = self.plane(number)
            rows, columns = (np.arange(n) * part // most for n, part, most in ((self.frame.height, down, self.tallest), (self.frame.width, across, self.widest)))
            planes.append(own[rows][:, columns])
        out = np.stack(planes, axis=2)
        if len(planes) < 3 or plain_rgb:
            return out
        y, cb, cr = (out[:, :, i].astype(np.float64) - (128 if i else 0) for i in range(3))
        return np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)), 0, 255).astype(np.uint8)


RESTARTS = re.compile(b"\xff[\xd0-\xd7]")
SCAN_END = re.compile(b"\xff[^\x00\xd0-\xd7\xff]")


def frame_of(marker: int, body: bytes) -> Frame:
    need(len(body) >= 6 and len(body) >= 6 + 3 * body[5] and body[5] in (1, 3, 4), "bad frame header")
    parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
    need(len(parts) == body[5] and all(0 < a < 5 and 0 < b < 5 for a, b, _ in parts.values()), "bad frame header")
    frame = Frame(int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), marker == 0xC2, marker in (0xC0, 0xC1, 0xC2) and body[0] == 8, parts)
    need(frame.width and frame.height, "empty picture")
    need(frame.readable, f"frame {marker:02X} of {body[0]} bits is not read")
    return frame


def scan_parts(frame: Frame, tables: Tables, body: bytes) -> list[tuple[int, int, int]]:
    """Components of a scan with the numbers of their Huffman tables."""
    need(body and len(body) == 4 + 2 * body[0] and body[0], "bad start of scan")
    parts = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
    need(all(p[0] in frame.parts for p in parts), "a scan of unknown components")
    for number, first, other in parts:
        need(frame.parts[number][2] in tables.steps, f"quantisation table {frame.parts[number][2]} is not defined")
        need(first in tables.codes and (frame.progressive or 0x10 | other in tables.codes), f"Huffman table {other} is not defined")
    return parts


def read_jpeg(data: bytes) -> Picture:
    at, frame, tables, held = 2, None, Tables(), None
    try:
        while True:
            at = data.find(b"\xff", at)
            need(0 <= at < len(data) - 1, "no start of scan" if frame else "no frame header")
            marker, at = data[at + 1], at + 1
            if marker in (0, 0xFF) or 0xD0 <= marker <= 0xD8 or marker == 1:
                at += marker != 0xFF
                continue
            need(marker != 0xD9, "no start of scan")
            size = int.from_bytes(data[at + 1 : at + 3], "big")
            body, at = data[at + 3 : at + 1 + size], at + 1 + size
            need(size >= 2 and len(body) == size - 2, "a segment is cut off")
            if marker == 0xDB:
                place = 0
                while place < len(body):
                    wide = 2 if body[place] >> 4 else 1
                    need(place + 64 * wide < len(body), "a quantisation table is cut off")
                    tables.steps[body[place] & 15] = [int.from_bytes(body[i : i + wide], "big") for i in range(place + 1, place + 1 + 64 * wide, wide)]
                    place += 1 + 64 * wide
            elif marker == 0xC4:
                tables.codes |= huffman_codes(body)
            elif marker == 0xDD:
                tables.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xEE and body[:5] == b"Adobe" and len(body) > 11:
                tables.plain_rgb = body[11] == 0
            elif f"FF{marker:02X}" in K.SOF:
                need(frame is None, "a second frame header")
                frame = frame_of(marker, body)
            elif marker == 0xDA:
                need(frame, "no frame header")
                parts = scan_parts(frame, tables, body)
                end = SCAN_END.search(data, at)
                scan, at = data[at : end.start() if end else len(data)], end.start() if end else len(data)
                need(held or not frame.progressive or body[-3] == 0, "no scan of block means")
                if held is None:
                    held = Coefficients(frame)
                elif frame.progressive:
                    break
                held.decode(tables, scan, parts, frame.progressive, body[-1] & 15 if frame.progressive else 0)
    except Broken:
        if held is None:
            raise
    mode = {1: "L", 3: "RGB", 4: "CMYK"}[len(frame.parts)]
    if frame.progressive or len(frame.parts) == 4:
        first = next(iter(held.blocks.values()))
        return Picture(frame.width, frame.height, mode, "JPEG", np.clip(first[:, :, 0] // 8 + 128, 0, 255).astype(np.uint8))
    pixels = held.pixels(tables.plain_rgb)
    return Picture(frame.width, frame.height, mode, "JPEG", greys(pixels), pixels)


READERS: list[tuple[str, Callable[[bytes], Picture]]] = [
    (K.SOI, read_jpeg), (K.PNG, read_png), (K.GIF87, read_gif), (K.GIF89, read_gif), (K.BMP, read_bmp), (K.TIFF_LE, read_tiff), (K.TIFF_BE, read_tiff),
]


def read(data: bytes) -> Picture:
    """The picture that begins at byte 0; Broken if there is none that can be read."""
    for mark, reader in READERS:
        if data.startswith(bytes.fromhex(mark)):
            try:
                return reader(data)
            except (IndexError, struct.error, MemoryError) as error:
                raise Broken(f"header is cut off: {error}") from error
    raise Broken("cannot identify image file")


def chunk(kind: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")


def write_png(pixels: np.ndarray) -> bytes:
    """A PNG of 8-bit pixels (height, width, 1 to 4 channels), lightly compressed."""
    height, width, channels = pixels.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1)
    header = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return bytes.fromhex(K.PNG) + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def write_bmp(pixels: np.ndarray) -> bytes:
    """A BMP of 24 bits, bottom row first; grey pixels become colours and further channels fall away."""
    rgb = np.repeat(pixels[:, :, :1], 3, axis=2) if pixels.shape[2] < 3 else pixels[:, :, :3]
    height, width, _ = rgb.shape
    stride = (3 * width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : 3 * width] = rgb[::-1, :, ::-1].reshape(height, -1)
    header = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + header + rows.tobytes()


def write_tiff(pixels: np.ndarray) -> bytes:
    """An uncompressed TIFF of 8-bit pixels in one strip; grey with transparency becomes grey."""
    pixels = pixels[:, :, :1] if pixels.shape[2] == 2 else pixels
    height, width, channels = pixels.shape
    depths = struct.pack("<4H", *[8] * 4)
    entries = [
        (256, 4, 1, width), (257, 4, 1, height), (258, 3, channels, 8), (259, 3, 1, 1), (262, 3, 1, 1 if channels == 1 else 2), (273, 4, 1, 16), (277, 3, 1, channels), (278, 4, 1, height), (279, 4, 1, pixels.size),
    ] + ([(338, 3, 1, 2)] if channels == 4 else [])
    body = pixels.tobytes() + b"\0" * (pixels.size % 2)
    table = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *(e if e[0] != 258 or channels < 3 else (258, 3, channels, 8))) for e in entries) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 16 + len(body)) + depths + body + table


class BitWriter:
    """Coded data of a scan, with bytes stuffed."""

    def __init__(self) -> None:
        self.out, self.held, self.left = bytearray(), 0, 0

    def put(self, value: int, n: int) -> None:
        self.held, self.left = self.held << n | value, self.left + n
        while self.left >= 8:
            byte = self.held >> self.left - 8 & 255
            self.out += bytes([byte, 0]) if byte == 255 else bytes([byte])
            self.left -= 8
        self.held &= (1 << self.left) - 1

    def number(self, value: int) -> None:
        """The bits of a number of its own size; negative ones are one less."""
        n = abs(value).bit_length()
        if n:
            self.put(value if value > 0 else value + (1 << n) - 1, n)

    def done(self) -> bytes:
        self.put((1 << -self.left % 8) - 1, -self.left % 8)
        return bytes(self.out)


def write_jpeg(pixels: np.ndarray, quality: int = 95) -> bytes:
    """A sequential JPEG of grey pixels or of colours without subsampling, with the standard's tables."""
    grey = pixels.shape[2] < 3
    parts = 1 if grey else 3
    height, width, _ = pixels.shape
    rgb = pixels[:, :, :parts].astype(np.float64)
    if grey:
        planes = [rgb[:, :, 0]]
    else:
        r, g, b = (rgb[:, :, i] for i in range(3))
        planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    segments = J.quantisation(parts, quality)
    steps = [list(segments[5 + 69 * i : 69 * (i + 1)]) for i in range(min(2, parts))]
    coded = []
    for i, plane in enumerate(planes):
        whole = np.pad(plane, ((0, -height % 8), (0, -width % 8)), mode="edge") - 128
        blocks = np.einsum("uy,aybx,vx->abuv", COSINES, whole.reshape(whole.shape[0] // 8, 8, whole.shape[1] // 8, 8), COSINES, optimize=True).reshape(whole.shape[0] // 8, whole.shape[1] // 8, 64)
        coded.append(np.rint(blocks[:, :, ZIGZAG] / np.array(steps[min(i, 1)])).astype(int).tolist())
    tables = J.huffman(parts)
    codes, at = {}, 0
    while at < len(tables):
        size = int.from_bytes(tables[at + 2 : at + 4], "big")
        for number, own in huffman_codes(tables[at + 4 : at + 2 + size]).items():
            codes[number] = {value: key for key, value in own.items()}
        at += 2 + size
    bits, before = BitWriter(), [0] * parts
    for y in range(len(coded[0])):
        for x in range(len(coded[0][0])):
            for i in range(parts):
                block, table = coded[i][y][x], min(i, 1)
                change, before[i] = block[0] - before[i], block[0]
                bits.put(*reversed(codes[table][abs(change).bit_length()]))
                bits.number(change)
                zeros, last = 0, max((k for k in range(1, 64) if block[k]), default=0)
                for value in block[1 : last + 1]:
                    if not value:
                        zeros += 1
                        continue
                    for _ in range(zeros // 16):
                        bits.put(*reversed(codes[0x10 | table][0xF0]))
                    bits.put(*reversed(codes[0x10 | table][zeros % 16 << 4 | abs(value).bit_length()]))
                    bits.number(value)
                    zeros = 0
                if last < 63:
                    bits.put(*reversed(codes[0x10 | table][0]))
    frame = struct.pack(">BHHB", 8, height, width, parts) + b"".join(bytes([i + 1, 0x11, min(i, 1)]) for i in range(parts))
    sof = J.segment("FFC0", frame)
    return bytes.fromhex(K.SOI) + J.JFIF + segments + sof + tables + J.scan_header(sof) + bits.done() + bytes.fromhex(K.EOI)


WRITERS: dict[str, Callable[[np.ndarray], bytes]] = {"png": write_png, "bmp": write_bmp, "tiff": write_tiff, "jpeg": write_jpeg}
