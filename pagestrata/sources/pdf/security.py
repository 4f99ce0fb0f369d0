"""Encrypted files: the standard security handler, versions 1, 2, 4 and 5 (RC4, AES-128, AES-256)."""

from __future__ import annotations

import hashlib
import stringprep
import struct
import unicodedata
from typing import Any

import numpy as np

# The padding of short passwords (ISO 32000-1, 7.6.3.3).
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


class PasswordError(ValueError):
    """Neither the user's nor the owner's password."""


# RC4


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, byte in enumerate(data):
        i = (i + 1) & 255
        a = s[i]
        j = (j + a) & 255
        b = s[i] = s[j]
        s[j] = a
        out[k] = byte ^ s[(a + b) & 255]
    return bytes(out)


# AES, from the arithmetic of the field of 256 elements (FIPS 197)


def _double(x: int) -> int:
    return (x << 1) ^ (0x11B if x & 128 else 0)


def _product(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a, b = _double(a), b >> 1
    return out


def _substitution() -> list[int]:
    """The inverse of each element under the affine map; powers of 3 give all inverses."""
    powers = [1]
    for _ in range(254):
        powers.append(powers[-1] ^ _double(powers[-1]))
    inverse = {powers[i]: powers[-i % 255] for i in range(255)}
    out = []
    for x in range(256):
        b = inverse.get(x, 0)
        v = 0x63
        for turn in range(5):
            v ^= (b << turn | b >> (8 - turn)) & 255
        out.append(v)
    return out


SBOX = _substitution()
_UNBOX = np.array([SBOX.index(x) for x in range(256)], dtype=np.uint8)
_TIMES = {k: np.array([_product(x, k) for x in range(256)], dtype=np.uint8) for k in (9, 11, 13, 14)}
# a column of the forward round, for the four rows of the state
_ROUND = [[int.from_bytes(bytes([*row[-turn:], *row[:-turn]] if turn else row), "big") for row in ([_double(s), s, s, _double(s) ^ s] for s in SBOX)] for turn in range(4)]
#: where the byte at (row, column) comes from when rows are shifted back; the state is stored by columns
_SHIFT_BACK = np.array([((c - r) % 4) * 4 + r for c in range(4) for r in range(4)])


def expand_key(key: bytes) -> list[list[int]]:
    """Round keys as four 32-bit columns each."""
    n = len(key) // 4
    words = [int.from_bytes(key[4 * i : 4 * i + 4], "big") for i in range(n)]
    substitute = lambda w: int.from_bytes(bytes(SBOX[b] for b in w.to_bytes(4, "big")), "big")
    turn = 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = substitute((w << 8 | w >> 24) & 0xFFFFFFFF) ^ turn << 24
            turn = _double(turn)
        elif n > 6 and i % n == 4:
            w = substitute(w)
        words.append(words[-n] ^ w)
    return [words[i : i + 4] for i in range(0, len(words), 4)]


def aes_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """CBC without padding; the data are whole blocks."""
    rounds, out = expand_key(key), []
    t0, t1, t2, t3 = _ROUND
    first, middle, last = rounds[0], rounds[1:-1], rounds[-1]
    a, b, c, d = struct.unpack(">4I", iv)
    for w, x, y, z in struct.iter_unpack(">4I", data):
        a, b, c, d = a ^ w ^ first[0], b ^ x ^ first[1], c ^ y ^ first[2], d ^ z ^ first[3]
        for p, q, r, s in middle:
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ p,
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ q,
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ r,
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ s,
            )
        a, b, c, d = ((SBOX[i >> 24] << 24 | SBOX[j >> 16 & 255] << 16 | SBOX[k >> 8 & 255] << 8 | SBOX[m & 255]) ^ n for i, j, k, m, n in ((a, b, c, d, last[0]), (b, c, d, a, last[1]), (c, d, a, b, last[2]), (d, a, b, c, last[3])))
        out.append(struct.pack(">4I", a, b, c, d))
    return b"".join(out)


def aes_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """CBC without padding, all blocks at once; a part of a block at the end is left out."""
    n = len(data) // 16
    if not n:
        return b""
    rounds = [np.frombuffer(b"".join(w.to_bytes(4, "big") for w in k), dtype=np.uint8) for k in expand_key(key)]
    given = np.frombuffer(data[: 16 * n], dtype=np.uint8).reshape(n, 16)
    state = given ^ rounds[-1]
    for k in reversed(rounds[:-1]):
        state = _UNBOX[state[:, _SHIFT_BACK]] ^ k
        if k is not rounds[0]:
            c = state.reshape(n, 4, 4)
            mixed = [_TIMES[14][c[:, :, r]] ^ _TIMES[11][c[:, :, (r + 1) % 4]] ^ _TIMES[13][c[:, :, (r + 2) % 4]] ^ _TIMES[9][c[:, :, (r + 3) % 4]] for r in range(4)]
            state = np.stack(mixed, axis=2).reshape(n, 16)
    before = np.vstack([np.frombuffer(iv, dtype=np.uint8)[None], given[:-1]])
    return (state ^ before).tobytes()


def unpad(data: bytes) -> bytes:
    """Without PKCS padding; as it is if that is damaged."""
    n = data[-1] if data else 0
    return data[:-n] if 0 < n <= 16 and n <= len(data) and data.endswith(bytes([n]) * n) else data


def pad(data: bytes) -> bytes:
    n = 16 - len(data) % 16
    return data + bytes([n]) * n


# Passwords


def saslprep(text: str) -> str:
    """A password by the profile of RFC 4013; raises for what it forbids."""
    mapped = "".join(" " if stringprep.in_table_c12(c) else c for c in text if not stringprep.in_table_b1(c))
    out = unicodedata.normalize("NFKC", mapped)
    bad = (stringprep.in_table_c12, stringprep.in_table_c21_c22, stringprep.in_table_c3, stringprep.in_table_c4, stringprep.in_table_c5, stringprep.in_table_c6, stringprep.in_table_c7, stringprep.in_table_c8, stringprep.in_table_c9, stringprep.in_table_a1)
    for c in out:
        if any(test(c) for test in bad):
            raise ValueError(f"a password has the forbidden character U+{ord(c):04X}")
    if any(stringprep.in_table_d1(c) for c in out):
        if any(stringprep.in_table_d2(c) for c in out):
            raise ValueError("a password has characters of both directions")
        if not (stringprep.in_table_d1(out[0]) and stringprep.in_table_d1(out[-1])):
            raise ValueError("a right-to-left password begins and ends with right-to-left characters")
    return out


def _old_password(password: str) -> bytes:
    return (password.encode("latin-1", "ignore") + PADDING)[:32]


def _new_password(password: str) -> bytes:
    try:
        password = saslprep(password)
    except ValueError:
        pass
    return password.encode("utf-8")[:127]


def hash_r5(password: bytes, salt: bytes, owned: bytes) -> bytes:
    return hashlib.sha256(password + salt + owned).digest()


def hash_r6(password: bytes, salt: bytes, owned: bytes) -> bytes:
    """Algorithm 2.B of ISO 32000-2."""
    k, i, last = hash_r5(password, salt, owned), 0, 0
    while i < 64 or last > i - 32:
        e = aes_encrypt(k[:16], k[16:32], (password + k + owned) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i, last = i + 1, e[-1]
    return k[:32]


class Security:
    """Opens strings and streams of a file once a password fits."""

    def __init__(self, attrs: dict[str, Any], file_id: bytes, password: str = ""):
        self.version, self.revision = int(attrs.get("V", 0)), int(attrs.get("R", 0))
        if str(attrs.get("Filter", "Standard")) != "Standard" or self.version not in (1, 2, 4, 5):
            raise ValueError(f"no such encryption: {attrs.get('Filter')} version {self.version}")
        self.o, self.u = bytes(attrs.get("O", b"")), bytes(attrs.get("U", b""))
        self.permissions = int(attrs.get("P", 0)) & 0xFFFFFFFF
        self.metadata = attrs.get("EncryptMetadata", True) is not False
        bits = int(attrs.get("Length", 40)) if self.version in (2, 4) else 40
        self.size = max(5, min(16, bits // 8 if bits >= 40 else bits))
        self.file_id, self.attrs = file_id, attrs
        self.stream_way = self.string_way = "V2"
        if self.version >= 4:
            filters = attrs.get("CF") or {}
            way = lambda k: "Identity" if str(attrs.get(k, "Identity")) == "Identity" else str((filters.get(str(attrs[k])) or {}).get("CFM", "None"))
            self.stream_way, self.string_way = way("StmF"), way("StrF")
            self.size = 16
        self.key = self._key_v5(password) if self.version == 5 else self._key(password)

    def _key(self, password: str) -> bytes:
        found = self._user_key(_old_password(password))
        if found is None:
            found = self._user_key(self._from_owner(_old_password(password)))
        if found is None:
            raise PasswordError("the password does not fit")
        return found

    def _from_owner(self, padded: bytes) -> bytes:
        """The padded user password that the owner's opens."""
        key = hashlib.md5(padded).digest()
        if self.revision >= 3:
            for _ in range(50):
                key = hashlib.md5(key).digest()
        key = key[: self.size]
        out = self.o[:32]
        for i in range(19, -1, -1) if self.revision >= 3 else (0,):
            out = rc4(bytes(b ^ i for b in key), out)
        return out

    def _user_key(self, padded: bytes) -> bytes | None:
        data = padded + self.o[:32] + self.permissions.to_bytes(4, "little") + self.file_id
        if self.revision >= 4 and not self.metadata:
            data += b"\xff" * 4
        key = hashlib.md5(data).digest()
        if self.revision >= 3:
            for _ in range(50):
                key = hashlib.md5(key[: self.size]).digest()
        key = key[: self.size]
        return key if self.user_mark(key)[:16] == self.u[:16] else None

    def user_mark(self, key: bytes) -> bytes:
        """What U begins with for a key."""
        if self.revision < 3:
            return rc4(key, PADDING)
        out = hashlib.md5(PADDING + self.file_id).digest()
        for i in range(20):
            out = rc4(bytes(b ^ i for b in key), out)
        return out

    def _key_v5(self, password: str) -> bytes:
        digest = hash_r6 if self.revision >= 6 else hash_r5
        raw, user = _new_password(password), self.u[:48]
        for mark, owned, field in ((self.o, user, "OE"), (self.u, b"", "UE")):
            if digest(raw, mark[32:40], owned) == mark[:32]:
                return aes_decrypt(digest(raw, mark[40:48], owned), bytes(16), bytes(self.attrs.get(field, b""))[:32])
        raise PasswordError("the password does not fit")

    def _object_key(self, number: int, generation: int, aes: bool) -> bytes:
        data = self.key + number.to_bytes(4, "little")[:3] + generation.to_bytes(4, "little")[:2] + (b"sAlT" if aes else b"")
        return hashlib.md5(data).digest()[: min(16, len(self.key) + 5)]

    def open(self, data: bytes, number: int, generation: int, way: str) -> bytes:
        if way in ("Identity", "None"):
            return data
        if way == "V2":
            return rc4(self._object_key(number, generation, False), data) if data else data
        key = self.key if way == "AESV3" else self._object_key(number, generation, True)
        return unpad(aes_decrypt(key, data[:16], data[16:])) if len(data) > 16 else b""

    def allows(self, bit: int) -> bool:
        """Bits count from 1: 3 prints, 4 modifies, 5 extracts."""
        return bool(self.permissions >> (bit - 1) & 1)
