"""Safetensors and GGUF headers: segments of one element type, parameter counts, header lengths."""

from __future__ import annotations

import json
import re
import struct
from math import prod

#: Element types of safetensors that are stored as floats; every other type is raw.
SAFETENSORS_TYPES = {"BF16": "bf16", "F16": "f16", "F32": "f32", "F64": "f64"}
MAX_HEADER = 100 * 1024 * 1024

#: GGUF tensor types by id: name, (elements, bytes) of a block where it is known, storage type.
GGML_TYPES = {
    0: ("F32", (1, 4), "f32"), 1: ("F16", (1, 2), "f16"), 2: ("Q4_0", (32, 18), "raw"), 3: ("Q4_1", (32, 20), "raw"),
    6: ("Q5_0", (32, 22), "raw"), 7: ("Q5_1", (32, 24), "raw"), 8: ("Q8_0", (32, 34), "raw"), 9: ("Q8_1", None, "raw"),
    10: ("Q2_K", (256, 84), "raw"), 11: ("Q3_K", (256, 110), "raw"), 12: ("Q4_K", (256, 144), "raw"),
    13: ("Q5_K", (256, 176), "raw"), 14: ("Q6_K", (256, 210), "raw"), 15: ("Q8_K", None, "raw"), 16: ("IQ2_XXS", None, "raw"),
    17: ("IQ2_XS", None, "raw"), 18: ("IQ3_XXS", None, "raw"), 19: ("IQ1_S", None, "raw"), 20: ("IQ4_NL", None, "raw"),
    21: ("IQ3_S", None, "raw"), 22: ("IQ2_S", None, "raw"), 23: ("IQ4_XS", None, "raw"), 24: ("I8", (1, 1), "raw"),
    25: ("I16", (1, 2), "raw"), 26: ("I32", (1, 4), "raw"), 27: ("I64", (1, 8), "raw"), 28: ("F64", (1, 8), "f64"),
    29: ("IQ1_M", None, "raw"), 30: ("BF16", (1, 2), "bf16"), 34: ("TQ1_0", None, "raw"), 35: ("TQ2_0", None, "raw"), 39: ("MXFP4", None, "raw"),
}
#: Sizes of GGUF's fixed-width metadata values by kind; 8 is a string, 9 an array.
_KV_SIZES = {0: 1, 1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 7: 1, 10: 8, 11: 8, 12: 8}
_STRING, _ARRAY, _NESTED = 8, 9, 8

Segment = tuple[int, int, str]


class FormatError(ValueError):
    """A file that claims a format it doesn't keep."""


def _cover(size: int, first: int, pieces: list[Segment]) -> list[Segment]:
    """Header, pieces in order, and raw gaps between and after them."""
    out, at = ([(0, first, "raw")] if first else []), first
    for a, b, dtype in sorted(pieces):
        if a < at or b > size:
            raise FormatError("pieces overlap or leave the file")
        if a > at:
            out.append((at, a, "raw"))
        if b > a:
            out.append((a, b, dtype))
        at = b
    return [*out, (at, size, "raw")] if at < size else out


def header_length(data: bytes) -> int | None:
    """The length of a safetensors header as its first eight bytes tell it; None while they aren't there."""
    return struct.unpack_from("<Q", data)[0] if len(data) >= 8 else None


def safetensors_header(data: bytes) -> tuple[int, dict] | None:
    """(length with its prefix, JSON) of a safetensors header; None if there is none, or it isn't all there."""
    if len(data) < 8:
        return None
    (n,) = struct.unpack_from("<Q", data)
    if n > MAX_HEADER or 8 + n > len(data):
        return None
    try:
        header = json.loads(data[8 : 8 + n])
    except ValueError:
        return None
    return (8 + n, header) if isinstance(header, dict) else None


def safetensors_segments(data: bytes, size: int | None = None) -> list[Segment] | None:
    """None if this is no safetensors file; FormatError if a tensor has no type or offsets, or tensors overlap or lie outside of the file.

    With the file's size, data need only hold the header."""
    got = safetensors_header(data)
    if got is None:
        return None
    first, header = got
    pieces = []
    for name, t in header.items():
        if name == "__metadata__":
            continue
        try:
            a, b = t["data_offsets"]
            dtype = SAFETENSORS_TYPES.get(t["dtype"], "raw")
        except (TypeError, KeyError, ValueError) as e:
            raise FormatError(f"{name}: no type or offsets") from e
        if not 0 <= a <= b:
            raise FormatError(f"{name}: offsets {a} to {b}")
        pieces.append((first + a, first + b, dtype))
    return _cover(len(data) if size is None else size, first, pieces)


def safetensors_params(data: bytes) -> dict[str, int] | None:
    """Elements per type, as named in the header; a scalar has one."""
    got = safetensors_header(data)
    if got is None:
        return None
    out: dict[str, int] = {}
    for name, t in got[1].items():
        if name != "__metadata__":
            out[t["dtype"]] = out.get(t["dtype"], 0) + prod(t["shape"])
    return out


class _Reader:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise FormatError("the header is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def text(self) -> bytes:
        return self.take(self.number(8))

    def skip(self, kind: int, depth: int = 0) -> bytes | None:
        if kind in _KV_SIZES:
            return self.take(_KV_SIZES[kind])
        if kind == _STRING:
            self.text()
        elif kind == _ARRAY and depth < _NESTED:
            inner, n = self.number(4), self.number(8)
            if inner in _KV_SIZES:
                self.take(_KV_SIZES[inner] * n)
            else:
                for _ in range(n):
                    self.skip(inner, depth + 1)
        else:
            raise FormatError(f"metadata of kind {kind}")
        return None


def gguf_header(data: bytes) -> tuple[int, list[tuple[str, list[int], int, int]]]:
    """(where the data begins, [(name, shape, type id, offset)]). FormatError for anything else than a whole header of version 2 or 3."""
    if data[:4] != b"GGUF":
        raise FormatError("no GGUF")
    r = _Reader(data, 4)
    version, tensors, pairs = r.number(4), r.number(8), r.number(8)
    if version not in (2, 3):
        raise FormatError(f"version {version}")
    align = 32
    for _ in range(pairs):
        name, kind = r.text(), r.number(4)
        value = r.skip(kind)
        if name == b"general.alignment":
            if kind != 4:
                raise FormatError(f"alignment of kind {kind}")
            align = int.from_bytes(value, "little")
    if align < 1 or align & (align - 1):
        raise FormatError(f"alignment {align}")
    if tensors * 24 > len(data) - r.at:
        raise FormatError(f"{tensors} tensors in a header that is too short for them")
    out = []
    for _ in range(tensors):
        name, rank = r.text().decode("utf-8", "replace"), r.number(4)
        if rank > 8:
            raise FormatError(f"{rank} dimensions")
        shape = [r.number(8) for _ in range(rank)]
        kind, offset = r.number(4), r.number(8)
        if offset % align:
            raise FormatError(f"{name} isn't aligned")
        out.append((name, shape, kind, offset))
    return -(-r.at // align) * align, out


def gguf_segments(data: bytes, size: int | None = None) -> list[Segment]:
    """Segments of a GGUF file. Whatever is wrong with it, the answer is one raw segment and never an error. With the file's size, data need only hold the header."""
    total = len(data) if size is None else size
    whole = [(0, total, "raw")] if total else []
    try:
        first, tensors = gguf_header(data)
        pieces = []
        tensors = sorted(tensors, key=lambda t: t[3])
        for (_, shape, kind, offset), then in zip(tensors, [*(first + t[3] for t in tensors[1:]), total]):
            block = GGML_TYPES.get(kind, (None, None, "raw"))
            end = then  # a tensor whose block size isn't known reaches to the next one
            if block[1] is not None:
                per, width = block[1]
                n = prod(shape)
                end = first + offset + n // per * width
                if n % per or end > then:
                    return whole
            if first + offset > end:
                return whole
            pieces.append((first + offset, end, block[2]))
        return _cover(total, first, pieces) if first <= total else whole
    except FormatError:
        return whole


def gguf_params(data: bytes) -> dict[str, int]:
    """Elements per type name; `type N` for unknown ids."""
    out: dict[str, int] = {}
    for _, shape, kind, _ in gguf_header(data)[1]:
        name = GGML_TYPES[kind][0] if kind in GGML_TYPES else f"type {kind}"
        out[name] = out.get(name, 0) + prod(shape)
    return out


def file_segments(path: str, data: bytes) -> list[Segment]:
    """By extension, letter case counting: safetensors, GGUF, else one raw segment."""
    ext = path.rpartition(".")[2] if "." in path else ""
    if ext == "safetensors":
        got = safetensors_segments(data)
        if got is not None:
            return got
    elif ext == "gguf":
        return gguf_segments(data)
    return [(0, len(data), "raw")] if data else []


SHARD = re.compile(r"^(.*)-([0-9]{5})-of-([0-9]{5})\.gguf$", re.S)


def gguf_shard(path: str) -> tuple[str, int] | None:
    """(set, number of shards) of a path like x-00001-of-00003.gguf."""
    m = SHARD.match(path)
    return (m[1], int(m[3])) if m else None
