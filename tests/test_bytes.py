"""Byte-level functions: exact round trips, published vectors, invariants, malformed input."""

import json
import os
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunklake.functions import chunker, codec, hashing
from chunklake.sources import formats


@given(st.binary(max_size=400), st.sampled_from(sorted(codec.WIDTHS)), st.booleans())
@settings(max_examples=200, deadline=None)
def test_codec_round_trip(raw, dtype, frames):
    blob = codec.encode(raw, dtype, frames)
    assert codec.decode(blob, len(raw)) == raw
    assert len(blob) <= len(raw) + 3


def test_every_bf16_and_many_f32():
    raw = np.arange(65536, dtype="<u2").tobytes() + b"\x01"
    assert codec.join_exponent(codec.split_exponent(raw, 2), 2) == raw
    f32 = (np.arange(200_000, dtype=np.uint64) * 0x9E3779B9 & 0xFFFFFFFF).astype("<u4").tobytes() + b"xyz"
    assert codec.join_exponent(codec.split_exponent(f32, 4), 4) == f32
    assert codec.split_exponent(struct.pack("<H", 0x3F80), 2) == bytes([127, 0])
    assert codec.split_planes(bytes([1, 2, 3, 4, 5, 6]), 2) == bytes([1, 3, 5, 2, 4, 6])


def test_bad_blobs():
    good = codec.encode(b"abc" * 100, "raw")
    for bad in (b"", good[:2], bytes([9]) + good[1:], bytes([1, 9]) + good[2:], good[:-1], good + b"x"):
        with pytest.raises(codec.BlobError):
            codec.decode(bad, 300)
    with pytest.raises(codec.BlobError):
        codec.decode(good, 299)
    with pytest.raises(codec.BlobError):
        codec.decode(bytes([1, 0, 0]) + b"x" * 300_000, 300_000)


def test_ties_keep_the_plainer_codec():
    assert codec.encode(b"", "f32")[1] == codec.STORED


def test_chunks_cover_segments():
    rnd = np.random.default_rng(5)
    data = rnd.integers(0, 256, 2_000_000, dtype=np.uint8).tobytes()
    segments = [(0, 100, "raw"), (100, 100, "f32"), (100, 900_100, "f32"), (900_100, 2_000_000, "bf16")]
    c = chunker.chunk(data, segments)
    assert c[0][0] == 0 and c[-1][1] == len(data)
    assert all(a[1] == b[0] for a, b in zip(c, c[1:]))
    assert all(b - a <= chunker.MOST for a, b, _ in c)
    ends = {e for _, e, _ in segments}
    assert all((b - 100) % 4 == 0 for a, b, t in c if t == "f32" and b not in ends)
    # an edit near the end leaves the chunks before it
    edited = data[:-50_000] + os.urandom(50_000)
    same = {data[a:b] for a, b, _ in c} & {edited[a:b] for a, b, _ in chunker.chunk(edited, segments)}
    assert len(same) >= len(c) - 6
    assert chunker.chunk(b"", []) == []


def test_rolling_hash_is_the_serial_one():
    data = np.frombuffer(os.urandom(3 * chunker.BLOCK + 77), np.uint8)
    h, out = 0, []
    for b in data[:3000]:
        h = ((h << 1) + int(chunker.gear()[b])) & 0xFFFF
        out.append(h)
    assert chunker.rolling(data[:3000]).tolist() == out
    at, strict = chunker.candidates(data)
    assert at.tolist() == (np.flatnonzero(chunker.rolling(data) < 2) + 1).tolist()
    for p, s in zip(at.tolist(), strict.tolist()):
        last = int.from_bytes(data[p - 8 : p].tobytes(), "little")
        assert s == ((last * chunker.MIX & (1 << 64) - 1) >> 62 == 0)


@pytest.mark.parametrize("dtype", ["raw", "bf16", "f32", "f64"])
def test_stream_makes_the_same_chunks(dtype):
    d = os.urandom(2_000_000) + bytes(700_000) + os.urandom(800_003)
    want = chunker.chunk(d, [(100, len(d) - 3, dtype)])
    for window in (70_001, 300_000, 1_000_003, 1 << 25):
        got = list(chunker.chunk_stream(lambda at, n: d[at : at + n], 100, len(d) - 3, dtype, window))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(x == d[a:b] for a, b, x in got)
    assert list(chunker.chunk_stream(lambda at, n: b"", 5, 5, dtype)) == []
    with pytest.raises(EOFError):
        list(chunker.chunk_stream(lambda at, n: d[at : at + n], 0, len(d) + 9, dtype))


def test_chunk_sizes_lie_about_the_usual_one():
    data = os.urandom(6_000_000)
    n = [b - a for a, b, _ in chunker.chunk(data, [(0, len(data), "raw")])]
    assert 40_000 < sum(n) / len(n) < 110_000 and min(n[:-1]) > chunker.LEAST


def test_published_hashes():
    assert hashing.blake3(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert hashing.blake3(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    secret = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    public, sig = hashing.ed25519_sign(secret, b"")
    assert public.hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    assert sig.hex().startswith("e5564300c360ac729086e2cc806e828a")
    assert hashing.ed25519_verify(public, b"", sig)
    assert not hashing.ed25519_verify(public, b"x", sig)
    assert not hashing.ed25519_verify(public[:5], b"", sig)


def safetensors(tensors, pad=0):
    at, header, body = 0, {"__metadata__": {"a": "b"}}, b""
    for name, dtype, shape, data in tensors:
        header[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at + pad, at + pad + len(data)]}
        body += b"\0" * pad + data
        at += pad + len(data)
    h = json.dumps(header).encode()
    return struct.pack("<Q", len(h)) + h + body


def test_safetensors():
    f = safetensors([("a", "BF16", [2, 3], b"x" * 12), ("b", "F8_E4M3", [4], b"y" * 4), ("c", "F32", [], b"z" * 4)], pad=2)
    s = formats.safetensors_segments(f)
    assert s[0][0] == 0 and s[-1][1] == len(f) and all(a[1] == b[0] for a, b in zip(s, s[1:]))
    assert [t for _, _, t in s] == ["raw", "raw", "bf16", "raw", "raw", "raw", "f32"]
    assert formats.safetensors_params(f) == {"BF16": 6, "F8_E4M3": 4, "F32": 1}
    assert formats.safetensors_segments(b"no") is None and formats.safetensors_segments(struct.pack("<Q", 1 << 40) + b"{}") is None
    bad = struct.pack("<Q", 80) + json.dumps({"a": {"dtype": "F32", "shape": [9], "data_offsets": [0, 36]}}).encode().ljust(80)
    with pytest.raises(formats.FormatError):
        formats.safetensors_segments(bad)


def gguf(tensors, align=32):
    text = lambda s: struct.pack("<Q", len(s)) + s
    kv = text(b"general.alignment") + struct.pack("<II", 4, align) + text(b"tokens") + struct.pack("<IIQ", 9, 8, 2) + text(b"a") + text(b"bb")
    head = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), 2) + kv
    at = 0
    body = b""
    for name, shape, kind, size in tensors:
        head += text(name) + struct.pack("<I", len(shape)) + b"".join(struct.pack("<Q", d) for d in shape) + struct.pack("<IQ", kind, at)
        body += b"d" * size + b"\0" * (-size % align)
        at = len(body)
    return head + b"\0" * (-len(head) % align) + body


def test_gguf():
    f = gguf([(b"emb", [64, 10], 8, 640 // 32 * 34), (b"norm", [64], 0, 256), (b"odd", [256], 16, 66)], 64)
    s = formats.gguf_segments(f)
    assert s[0][0] == 0 and s[-1][1] == len(f) and all(a[1] == b[0] for a, b in zip(s, s[1:]))
    assert "f32" in {t for _, _, t in s}
    assert formats.gguf_params(f) == {"Q8_0": 640, "F32": 64, "IQ2_XXS": 256}
    for i in range(0, len(f), 7):  # no damage may raise
        broken = f[:i] + bytes([f[i] ^ 0xFF]) + f[i + 1 :]
        t = formats.gguf_segments(broken)
        assert t[0][0] == 0 and t[-1][1] == len(f)
    assert formats.gguf_segments(b"GG") == [(0, 2, "raw")]
    assert formats.gguf_shard("m-00001-of-00003.gguf") == ("m", 3)
    assert formats.gguf_shard("m-0001-of-00003.gguf") is None
    assert formats.file_segments("x.GGUF", f) == [(0, len(f), "raw")]


@pytest.mark.parametrize("kind", ["random", "words", "constant"])
def test_cuts_follow_the_rule_step_by_step(kind):
    rnd = np.random.default_rng(5)
    data = {"random": rnd.integers(0, 256, 700_000, dtype=np.uint8).tobytes(), "words": b" ".join(rnd.choice([b"cold", b"cache", b"node", b"block"], 120_000).tolist()), "constant": b"*" * 600_000}[kind]
    gear, ends, start, h = chunker.gear().tolist(), [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + gear[b]) & 0xFFFF
        at = i + 1
        n = at - start
        lax = h < 2
        strict = lax and (int.from_bytes(data[max(at - 8, 0) : at].rjust(8, b"\0"), "little") * chunker.MIX & (1 << 64) - 1) >> 62 == 0
        if n > chunker.LEAST and (strict and n <= chunker.USUAL or lax and n > chunker.USUAL) or n == chunker.MOST:
            ends.append(at)
            start = at
    if start < len(data):
        ends.append(len(data))
    assert chunker.cuts(data) == ends and len(ends) > 2
