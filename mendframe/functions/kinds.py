"""Fixed values of media formats: kinds, extensions, byte signatures, markers, brands."""
from __future__ import annotations

# fixed values: kinds
IMAGE_KINDS = ["jpeg", "png", "gif", "bmp", "tiff", "webp", "heif", "avif", "jp2", "raw"]
VIDEO_KINDS = ["mp4", "mov", "avi", "mkv", "webm", "mpegts", "mpegps", "flv", "asf", "wmv"]
ISOBMFF_KINDS = ["mp4", "mov", "heif", "avif", "jp2"]
SAVABLE_KINDS = ["jpeg", "png", "gif", "bmp", "tiff", "webp"]

# fixed values: extensions of each kind
EXTENSIONS = {
    "jpeg": ["jpg", "jpeg", "jpe", "jfif"], "png": ["png"], "gif": ["gif"], "bmp": ["bmp"], "tiff": ["tif", "tiff"], "webp": ["webp"],
    "heif": ["heic", "heif"], "avif": ["avif"], "jp2": ["jp2", "j2k", "jpf", "jpx"], "raw": ["raw", "dng", "nef", "cr2", "cr3", "arw"],
    "mp4": ["mp4", "m4v"], "mov": ["mov"], "avi": ["avi"], "mkv": ["mkv"], "webm": ["webm"], "mpegts": ["ts", "m2ts", "mts"],
    "mpegps": ["mpg", "mpeg", "vob"], "flv": ["flv"], "asf": ["asf"], "wmv": ["wmv"],
}
KIND_OF_EXTENSION = {e: k for k, es in EXTENSIONS.items() for e in es}
VIDEO_OUTPUT = {"mpegts": ".ts", "mpegps": ".mpg"}
OTHER_VIDEO_OUTPUT = ".mkv"

# fixed values: byte strings in hexadecimal
SOI, EOI, SOS, DQT, DHT, DRI, APP0, APP1, COM = "FFD8", "FFD9", "FFDA", "FFDB", "FFC4", "FFDD", "FFE0", "FFE1", "FFFE"
SOF = [f"FF{b:02X}" for b in range(0xC0, 0xD0) if b not in (0xC4, 0xC8, 0xCC)]
RST = [f"FF{b:02X}" for b in range(0xD0, 0xD8)]
APP = [f"FF{b:02X}" for b in range(0xE0, 0xF0)]
PNG, IHDR, IDAT, IEND = "89504E470D0A1A0A", "49484452", "49444154", "0000000049454E44AE426082"
GIF87, GIF89, BMP, TIFF_LE, TIFF_BE = "474946383761", "474946383961", "424D", "49492A00", "4D4D002A"
RIFF, WEBP, AVI, FTYP = "52494646", "57454250", "41564920", "66747970"
EBML, FLV, PS_PACK, JP2, ASF = "1A45DFA3", "464C56", "000001BA", "0000000C6A5020200D0A870A", "3026B2758E66CF11A6D900AA0062CE6C"
GIF_TRAILER, GIF_SEPARATOR, TS_SYNC = "3B", "2C", "47"

# fixed values: simple signatures as (family, type, needles, confidence at offset 0, confidence elsewhere)
SIGNATURES = [
    ("jpeg", "jpeg_soi", [SOI], 0.99, 0.90), ("png", "png_sig", [PNG], 0.99, 0.90), ("gif", "gif_header", [GIF87, GIF89], 0.98, 0.88),
    ("bmp", "bmp_header", [BMP], 0.95, 0.65), ("tiff", "tiff_header", [TIFF_LE, TIFF_BE], 0.98, 0.88), ("flv", "flv_header", [FLV], 0.98, 0.85),
    ("mpegps", "mpegps_pack", [PS_PACK], 0.98, 0.85), ("asf", "asf_guid", [ASF], 0.98, 0.85), ("jp2", "jp2_sig", [JP2], 0.99, 0.90),
]

# fixed values: brands of ISO base media files; any other brand is mp4
BRANDS = {
    "mov": ["qt  "], "heif": ["heic", "heix", "hevc", "hevx", "mif1", "msf1"], "avif": ["avif", "avis"], "jp2": ["jp2 ", "jpx ", "jph "],
    "mp4": ["isom", "iso2", "mp41", "mp42", "avc1", "dash"],
}
KIND_OF_BRAND = {b: k for k, bs in BRANDS.items() for b in bs}

HITS_PER_TYPE = 24
TS_WINDOW, TS_PACKET, TS_LEAST = 8192, 188, 4
