"""Standard JPEG tables of ITU-T T.81 Annex K as segments, and segments that follow from a frame header."""
from __future__ import annotations

from functools import lru_cache

# fixed values: quantisation tables K.1 and K.2, by rows
LUMINANCE = """16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"""
CHROMINANCE = """17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99"""
# fixed values: Huffman tables K.3 to K.6 as code counts by length and values, in hexadecimal
DC_LUMINANCE = "00010501010101010100000000000000 000102030405060708090A0B"
DC_CHROMINANCE = "00030101010101010101010000000000 000102030405060708090A0B"
AC_LUMINANCE = """0002010303020403050504040000017D 01020300041105122131410613516107227114328191A1082342B1C11552D1F02433627282
090A161718191A25262728292A3435363738393A434445464748494A535455565758595A636465666768696A737475767778797A
838485868788898A92939495969798999AA2A3A4A5A6A7A8A9AAB2B3B4B5B6B7B8B9BAC2C3C4C5C6C7C8C9CAD2D3D4D5D6D7D8D9DA
E1E2E3E4E5E6E7E8E9EAF1F2F3F4F5F6F7F8F9FA"""
AC_CHROMINANCE = """00020102040403040705040400010277 000102031104052131061241510761711322328108144291A1B1C109233352F0156272D10A162434E125F1
1718191A262728292A35363738393A434445464748494A535455565758595A636465666768696A737475767778797A
82838485868788898A92939495969798999AA2A3A4A5A6A7A8A9AAB2B3B4B5B6B7B8B9BAC2C3C4C5C6C7C8C9CAD2D3D4D5D6D7D8D9DA
E2E3E4E5E6E7E8E9EAF2F3F4F5F6F7F8F9FA"""
QUALITIES = (75, 85, 95)
JFIF = bytes.fromhex("FFE000104A46494600010100000100010000")


def zigzag() -> list[int]:
    """Places of an 8 x 8 block in the order of its diagonals, which turn by turns."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda rc: (sum(rc), rc[1] if sum(rc) % 2 == 0 else rc[0]))
    return [8 * r + c for r, c in cells]


def segment(marker: str, body: bytes) -> bytes:
    return bytes.fromhex(marker) + (len(body) + 2).to_bytes(2, "big") + body


def _quantisation(table: str, number: int, quality: int) -> bytes:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    scaled = [min(255, max(1, (int(v) * scale + 50) // 100)) for v in table.split()]
    return segment("FFDB", bytes([number, *(scaled[i] for i in zigzag())]))


@lru_cache(maxsize=None)
def quantisation(components: int, quality: int) -> bytes:
    """DQT segments for grey (1 component) or colour."""
    return _quantisation(LUMINANCE, 0, quality) + (_quantisation(CHROMINANCE, 1, quality) if components > 1 else b"")


@lru_cache(maxsize=None)
def huffman(components: int) -> bytes:
    """DHT segments for grey (1 component) or colour."""
    tables = [(0x00, DC_LUMINANCE), (0x10, AC_LUMINANCE), (0x01, DC_CHROMINANCE), (0x11, AC_CHROMINANCE)]
    return b"".join(segment("FFC4", bytes([number]) + bytes.fromhex("".join(table.split()))) for number, table in tables[: 4 if components > 1 else 2])


def shade(components: int) -> str:
    return "color" if components > 1 else "gray"


def component_ids(sof: bytes) -> list[int]:
    """Component numbers of a frame header, none if it is too short for what it states."""
    n = sof[9] if len(sof) >= 10 else 0
    return [sof[10 + 3 * i] for i in range(n)] if len(sof) >= 10 + 3 * n else []


def scan_header(sof: bytes) -> bytes:
    """A start of scan for all components of a frame: the first with tables 0, the others with tables 1; empty without any.

    It states the number of components, as the standard asks, so that decoders take what follows for coded data.
    """
    ids = component_ids(sof)
    pairs = b"".join(bytes([c, 0x11 if i else 0x00]) for i, c in enumerate(ids))
    return bytes.fromhex("FFDA") + (6 + 2 * len(ids)).to_bytes(2, "big") + bytes([len(ids)]) + pairs + bytes.fromhex("003F00") if ids else b""
