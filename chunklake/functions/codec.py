"""Lossless transforms and blob encoding of chunks (pure numpy and zstandard; used inside Arrow batches)."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import zstandard

#: Element widths of storage types, blob codecs, float kinds and limits.
WIDTHS = {"raw": 1, "bf16": 2, "f16": 2, "f32": 4, "f64": 8}
STORED, ZSTD, PLANES, EXPONENT, PLANE_FRAMES, EXPONENT_FRAMES = range(6)
FLOAT_KINDS = {"bf16": 2, "f32": 4}
LEVEL = 3
MAX_CHUNK = 256 * 1024
VERSIONS = (1, 2)


class BlobError(ValueError):
    """A blob that can't be decoded."""


def split_planes(raw: bytes, width: int) -> bytes:
    """Plane k holds byte k of every element; bytes after the last whole element follow as they are."""
    if width == 1:
        return raw
    n = len(raw) // width
    body = np.frombuffer(raw, np.uint8, n * width).reshape(n, width)
    return body.T.tobytes() + bytes(raw[n * width :])


def join_planes(planes: bytes, width: int) -> bytes:
    if width == 1:
        return planes
    n = len(planes) // width
    body = np.frombuffer(planes, np.uint8, n * width).reshape(width, n)
    return body.T.tobytes() + bytes(planes[n * width :])


def split_exponent(raw: bytes, width: int) -> bytes:
    """Planes with the exponent alone first: BF16 as [exponent][sign, 7 bits], F32 as [exponent][byte 0][byte 1][sign, 7 bits].

    Elements are taken as whole numbers, so every step runs over contiguous memory."""
    n = len(raw) // width
    x = np.frombuffer(raw, f"<u{width}", n)
    out = np.empty((width, n), np.uint8)
    top = x if width == 2 else (x >> 16).astype(np.uint16)
    out[0] = top >> 7
    for k in range(width - 2):
        out[1 + k] = x >> 8 * k
    out[-1] = (top >> 8) & 0x80 | top & 0x7F
    return out.tobytes() + bytes(raw[n * width :])


def join_exponent(planes: bytes, width: int) -> bytes:
    n = len(planes) // width
    p = np.frombuffer(planes, np.uint8, n * width).reshape(width, n)
    out = p[0].astype(np.uint16)
    out <<= 7
    rest = p[-1].astype(np.uint16)
    out |= rest & 0x7F
    rest &= 0x80
    rest <<= 8
    out |= rest
    if width == 4:
        out = out.astype(np.uint32)
        for k in (1, 0):
            out <<= 8
            out |= p[1 + k]
    return out.tobytes() + bytes(planes[n * width :])


@lru_cache
def _compressor() -> zstandard.ZstdCompressor:
    """One per process: a worker runs one thread, and making a context costs more than a small chunk."""
    return zstandard.ZstdCompressor(level=LEVEL)


@lru_cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _frames(planes: bytes, width: int) -> bytes:
    """Each plane as its own frame with a little-endian length before it; the tail belongs to the last plane."""
    n = len(planes) // width
    cuts = [k * n for k in range(width)] + [len(planes)]
    c = _compressor()
    return b"".join(struct.pack("<I", len(f)) + f for f in (c.compress(planes[a:b]) for a, b in zip(cuts, cuts[1:])))


def encode(raw: bytes, dtype: str, plane_frames: bool = False) -> bytes:
    """[version][codec][param][payload]: the smallest of the codecs that suit the type; of equal ones the plainer."""
    width, c = WIDTHS[dtype], _compressor()
    options = [(STORED, 0, raw), (ZSTD, 0, c.compress(raw))]
    planes, codec, param = None, None, width
    if dtype in FLOAT_KINDS:
        planes, codec, param = split_exponent(raw, width), EXPONENT, FLOAT_KINDS[dtype]
    elif width > 1:
        planes, codec = split_planes(raw, width), PLANES
    if planes is not None:
        options.append((codec, param, c.compress(planes)))
        if plane_frames and len(raw) >= width:
            options.append((EXPONENT_FRAMES if codec == EXPONENT else PLANE_FRAMES, param, _frames(planes, width)))
    codec, param, payload = min(options, key=lambda o: len(o[2]))
    return b"".join((bytes([2 if codec >= PLANE_FRAMES else 1, codec, param]), payload))


def _expand(frame: bytes, size: int) -> bytes:
    try:
        out = _decompressor().decompress(frame, max_output_size=max(size, 1), allow_extra_data=False)
    except zstandard.ZstdError as e:
        raise BlobError(str(e)) from e
    if len(out) != size:
        raise BlobError("the length is not as announced")
    return out


def decode(blob: bytes, size: int) -> bytes:
    """The raw bytes of a blob, which must be `size` long."""
    if len(blob) < 3 or size > MAX_CHUNK:
        raise BlobError("no blob, or too large a chunk")
    version, codec, param = blob[:3]
    payload = blob[3:]
    if version not in VERSIONS or codec > EXPONENT_FRAMES or (codec >= PLANE_FRAMES) and version < 2:
        raise BlobError(f"version {version}, codec {codec}: not known")
    if codec in (PLANES, PLANE_FRAMES) and param not in (2, 4, 8) or codec in (EXPONENT, EXPONENT_FRAMES) and param not in (2, 4):
        raise BlobError(f"parameter {param}")
    if codec == STORED:
        if len(payload) != size:
            raise BlobError("the length is not as announced")
        return bytes(payload)
    if codec in (ZSTD, PLANES, EXPONENT):
        flat = _expand(payload, size)
    else:
        n, at, parts = size // param, 0, []
        for k in range(param):
            want = n if k < param - 1 else size - n * (param - 1)
            if at + 4 > len(payload):
                raise BlobError("a frame is missing")
            (length,) = struct.unpack_from("<I", payload, at)
            if at + 4 + length > len(payload):
                raise BlobError("a frame is cut off")
            parts.append(_expand(payload[at + 4 : at + 4 + length], want))
            at += 4 + length
        if at != len(payload):
            raise BlobError("bytes after the last frame")
        flat = b"".join(parts)
    if codec == ZSTD:
        return flat
    return join_planes(flat, param) if codec in (PLANES, PLANE_FRAMES) else join_exponent(flat, param)
