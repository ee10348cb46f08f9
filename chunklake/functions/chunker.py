"""Content-defined chunks within segments of one element type, after the published gear-hash scheme with two masks."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

from chunklake.functions.codec import WIDTHS

#: Least, usual and largest size of a chunk.
LEAST, USUAL, MOST = 16 * 1024, 64 * 1024, 256 * 1024
WINDOW = 16
BLOCK = 1 << 17
MIX = 0x9E3779B97F4A7C15


@lru_cache
def gear() -> np.ndarray:
    """256 pseudo-random words of 16 bits, made from a rule: the first 2 bytes of MD5 of 64 times the byte."""
    return np.array([int.from_bytes(hashlib.md5(bytes([i]) * 64).digest()[:2], "big") for i in range(256)], np.uint16)


def rolling(data: np.ndarray, out: np.ndarray | None = None, spare: np.ndarray | None = None) -> np.ndarray:
    """The gear hash over the last 16 bytes at each position: h = (h << 1) + gear[byte], by doubling the window four times."""
    n = len(data)
    h = np.empty(n, np.uint16) if out is None else out[:n]
    spare = np.empty(n, np.uint16) if spare is None else spare
    np.take(gear(), data, out=h, mode="clip")
    step = 1
    while step < WINDOW:
        t = spare[: max(n - step, 0)]
        np.left_shift(h[:-step], np.uint16(step), out=t)
        np.add(h[step:], t, out=h[step:])
        step *= 2
    return h


def candidates(data: np.ndarray, usual: int = USUAL) -> tuple[np.ndarray, np.ndarray]:
    """(positions after which a chunk may end once it is past `usual`, whether it may end there before that too).

    The lax test asks for one leading zero bit less than the logarithm of `usual`, the strict one for two bits more, which
    come from the last 8 bytes. Blocks of the data are hashed one after the other, so that the work stays in the cache."""
    below = np.uint16(1 << max(17 - (usual.bit_length() - 1), 0))
    h, spare = np.empty(BLOCK + WINDOW, np.uint16), np.empty(BLOCK + WINDOW, np.uint16)
    found = []
    for i in range(0, len(data), BLOCK):
        lead = min(i, WINDOW - 1)
        found.append(np.flatnonzero(rolling(data[i - lead : i + BLOCK], h, spare)[lead:] < below) + (i + 1))
    at = np.concatenate(found)
    last = data[np.maximum(at[:, None] - 8 + np.arange(8), 0)].view("<u8")[:, 0]
    return at, (last * np.uint64(MIX)) >> np.uint64(62) == 0


def cuts(data: bytes, least: int = LEAST, usual: int = USUAL, most: int = MOST) -> list[int]:
    """Ends of the chunks of data: at the first position past `least` that passes the strict test, past `usual` the lax one, at `most` at the latest."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    at_lax, strict = candidates(np.frombuffer(data, np.uint8), usual)
    at_strict = at_lax[strict]
    out, start = [], 0
    while n - start > least:
        end = min(start + most, n)
        middle = min(start + usual, end)
        i = np.searchsorted(at_strict, start + least, "right")
        if i < len(at_strict) and at_strict[i] <= middle:
            cut = int(at_strict[i])
        else:
            i = np.searchsorted(at_lax, middle, "right")
            cut = int(at_lax[i]) if i < len(at_lax) and at_lax[i] < end else end
        out.append(cut)
        start = cut
    if start < n:
        out.append(n)
    return out


def chunk(data: bytes, segments: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, dtype) of the chunks of a file's segments. No chunk crosses a segment; cuts fall on whole elements; empty segments have none."""
    out = []
    for start, end, dtype in segments:
        width, before = WIDTHS[dtype], start
        for c in cuts(data[start:end]):
            to = end if start + c == end else start + c - c % width
            if to > before:
                out.append((before, to, dtype))
                before = to
    return out


def chunk_stream(read, start: int, end: int, dtype: str, window: int = 32 << 20):
    """(start, end, bytes) of the chunks of one segment, read window by window; the same cuts as `chunk` makes of the whole segment.

    read(at, n) gives n bytes of the file. A cut is certain when `most` bytes lie behind the start of its chunk, so the last ones of a
    window are sought again together with the next, from the same cut on."""
    width = WIDTHS[dtype]
    base = given = start  # the last certain cut, and the element where the last chunk given ends (at or just before it)
    held = b""  # the bytes from `given` on
    while given < end:
        have = given + len(held)
        more = read(have, min(window, end - have)) if have < end else b""
        if have < end and not more:
            raise EOFError(f"the file ends at {have}, before {end}")
        held += more
        last = given + len(held) >= end
        skip, first, done = base - given, given, base
        for c in cuts(held[skip:]):
            if not last and given + len(held) - done < MOST:
                break
            done = base + c
            to = end if done == end else start + (done - start) - (done - start) % width
            if to > first:
                yield first, to, held[first - given : to - given]
                first = to
        held = held[first - given :]
        given, base = first, done
