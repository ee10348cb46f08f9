"""Hashes Spark lacks. The engine's content id is SHA-256 (built in); BLAKE3 is here for conformance, Ed25519 for signatures."""

from __future__ import annotations

import hashlib
import struct

#: Initial state, message order and flags of the published hash.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT, _KEYED = 1, 2, 4, 8, 16
_COLUMNS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
_M = 0xFFFFFFFF


def _compress(cv: tuple, block: tuple, counter: int, length: int, flags: int) -> list[int]:
    v = [*cv, *_IV[:4], counter & _M, counter >> 32, length, flags]
    m = list(block)
    for r in range(7):
        for i, (a, b, c, d) in enumerate(_COLUMNS):
            for x, turns in ((m[2 * i], (16, 12)), (m[2 * i + 1], (8, 7))):
                v[a] = (v[a] + v[b] + x) & _M
                t = v[d] ^ v[a]
                v[d] = (t >> turns[0] | t << (32 - turns[0])) & _M
                v[c] = (v[c] + v[d]) & _M
                t = v[b] ^ v[c]
                v[b] = (t >> turns[1] | t << (32 - turns[1])) & _M
        if r < 6:
            m = [m[k] for k in _ORDER]
    return [v[i] ^ v[i + 8] for i in range(8)]


def blake3(data: bytes, key: bytes | None = None) -> str:
    """The 32-byte BLAKE3 hash in hex; keyed with a key of 32 bytes. In plain Python: for conformance, not for volume."""
    start = struct.unpack("<8I", key) if key else _IV
    base = _KEYED if key else 0

    def leaf(chunk: bytes, n: int, root: int) -> tuple:
        cv, blocks = start, [chunk[i : i + 64] for i in range(0, len(chunk), 64)] or [b""]
        for i, b in enumerate(blocks):
            last = i == len(blocks) - 1
            flags = base | (_CHUNK_START if i == 0 else 0) | ((_CHUNK_END | root) if last else 0)
            cv = tuple(_compress(cv, struct.unpack("<16I", b.ljust(64, b"\0")), n, len(b), flags))
        return cv

    def node(lo: int, hi: int, root: int) -> tuple:
        if hi - lo == 1:
            return leaf(data[lo * 1024 : hi * 1024], lo, root)
        mid = lo + (1 << (hi - lo - 1).bit_length() - 1)
        return tuple(_compress(start, node(lo, mid, 0) + node(mid, hi, 0), 0, 64, base | _PARENT | root))

    return struct.pack("<8I", *node(0, max(1, -(-len(data) // 1024)), _ROOT)).hex()


# Ed25519, RFC 8032
_P = 2**255 - 19
_Q = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, _P - 2, _P) % _P


def _add(p: tuple, q: tuple) -> tuple:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % _P, (p[1] + p[0]) * (q[1] + q[0]) % _P
    c, d = 2 * p[3] * q[3] * _D % _P, 2 * p[2] * q[2] % _P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _times(s: int, p: tuple) -> tuple:
    q = (0, 1, 1, 0)
    while s:
        if s & 1:
            q = _add(q, p)
        p, s = _add(p, p), s >> 1
    return q


def _point(b: bytes) -> tuple | None:
    y = int.from_bytes(b, "little")
    sign, y = y >> 255, y & (1 << 255) - 1
    if y >= _P:
        return None
    x2 = (y * y - 1) * pow(_D * y * y + 1, _P - 2, _P) % _P
    x = pow(x2, (_P + 3) // 8, _P)
    if (x * x - x2) % _P:
        x = x * pow(2, (_P - 1) // 4, _P) % _P
    if (x * x - x2) % _P or x == 0 and sign:
        return None
    x = _P - x if x & 1 != sign else x
    return x, y, 1, x * y % _P


_BASE_Y = 4 * pow(5, _P - 2, _P) % _P
_BASE = _point(_BASE_Y.to_bytes(32, "little"))


def _bytes(p: tuple) -> bytes:
    z = pow(p[2], _P - 2, _P)
    return (p[1] * z % _P | (p[0] * z % _P & 1) << 255).to_bytes(32, "little")


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % _Q


def ed25519_sign(secret: bytes, message: bytes) -> tuple[bytes, bytes]:
    """(public key, signature) of a message by a secret of 32 bytes."""
    h = hashlib.sha512(secret).digest()
    a = int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254
    public = _bytes(_times(a, _BASE))
    r = _number(h[32:], message)
    top = _bytes(_times(r, _BASE))
    return public, top + ((r + _number(top, public, message) * a) % _Q).to_bytes(32, "little")


def ed25519_verify(public: bytes, message: bytes, signature: bytes) -> bool:
    """Whether a signature is that of the message by the public key; malformed input is false."""
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r = _point(public), _point(signature[:32])
    s = int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= _Q:
        return False
    left, right = _times(s, _BASE), _add(r, _times(_number(signature[:32], public, message), a))
    return (left[0] * right[2] - right[0] * left[2]) % _P == 0 == (left[1] * right[2] - right[1] * left[2]) % _P
