"""The standard security handler of PDF files: keys from the empty password, RC4 and AES (Spark is not imported here)."""

from __future__ import annotations

import hashlib

# Fixed value: the padding of passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    box, j = list(range(256)), 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) & 255
        box[i], box[j] = box[j], box[i]
    out, i, j = bytearray(), 0, 0
    for byte in data:
        i = (i + 1) & 255
        j = (j + box[i]) & 255
        box[i], box[j] = box[j], box[i]
        out.append(byte ^ box[(box[i] + box[j]) & 255])
    return bytes(out)


def _times(a: int, b: int) -> int:
    """Product in the field of 256 elements."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _boxes() -> tuple[list[int], list[int]]:
    """The substitution of bytes and its inverse: the inverse in the field, then a fixed affine map."""
    box = []
    for x in range(256):
        y = x
        for _ in range(6):  # x ** 254 by squaring
            y = _times(_times(y, y), x)
        y = _times(y, y)
        z = 0x63
        for k in range(5):
            z ^= ((y << k) | (y >> (8 - k))) & 255
        box.append(z)
    back = [0] * 256
    for x, y in enumerate(box):
        back[y] = x
    return box, back


BOX, BACK = _boxes()
#: Products by the factors of the column mix and of its inverse.
BY = {k: [_times(x, k) for x in range(256)] for k in (2, 3, 9, 11, 13, 14)}


class Aes:
    """AES with a key of 16 or 32 bytes; blocks are bytes in order, a column being four of them."""

    def __init__(self, key: bytes):
        words = [list(key[i : i + 4]) for i in range(0, len(key), 4)]
        n, self.rounds = len(words), len(words) + 6
        factor = 1
        while len(words) < 4 * (self.rounds + 1):
            w = list(words[-1])
            if len(words) % n == 0:
                w = [BOX[x] for x in w[1:] + w[:1]]
                w[0] ^= factor
                factor = _times(factor, 2)
            elif n > 6 and len(words) % n == 4:
                w = [BOX[x] for x in w]
            words.append([a ^ b for a, b in zip(w, words[-n], strict=True)])
        self.keys = [sum(words[4 * r : 4 * r + 4], []) for r in range(self.rounds + 1)]

    def encrypt(self, block: bytes) -> bytes:
        s = [a ^ b for a, b in zip(block, self.keys[0], strict=True)]
        for r in range(1, self.rounds + 1):
            s = [BOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]  # bytes replaced, rows shifted to the left
            if r < self.rounds:
                s = [BY[2][s[i]] ^ BY[3][s[i - i % 4 + (i + 1) % 4]] ^ s[i - i % 4 + (i + 2) % 4] ^ s[i - i % 4 + (i + 3) % 4] for i in range(16)]
            s = [a ^ b for a, b in zip(s, self.keys[r], strict=True)]
        return bytes(s)

    def decrypt(self, block: bytes) -> bytes:
        s = [a ^ b for a, b in zip(block, self.keys[-1], strict=True)]
        for r in range(self.rounds - 1, -1, -1):
            s = [BACK[s[(i - 4 * (i % 4)) % 16]] for i in range(16)]
            s = [a ^ b for a, b in zip(s, self.keys[r], strict=True)]
            if r:
                s = [BY[14][s[i]] ^ BY[11][s[i - i % 4 + (i + 1) % 4]] ^ BY[13][s[i - i % 4 + (i + 2) % 4]] ^ BY[9][s[i - i % 4 + (i + 3) % 4]] for i in range(16)]
        return bytes(s)


def cbc_decrypt(key: bytes, data: bytes, start: bytes | None = None) -> bytes:
    """Without a start the first block is it, and the padding is taken off."""
    own = start is None
    start, data = (data[:16], data[16:]) if own else (start, data)
    aes, out = Aes(key), bytearray()
    for i in range(0, len(data) - 15, 16):
        block = data[i : i + 16]
        out += bytes(a ^ b for a, b in zip(aes.decrypt(block), start, strict=True))
        start = block
    if own and out and 1 <= out[-1] <= 16:
        del out[-out[-1] :]
    return bytes(out)


def cbc_encrypt(key: bytes, data: bytes, start: bytes) -> bytes:
    aes, out = Aes(key), bytearray()
    for i in range(0, len(data), 16):
        start = aes.encrypt(bytes(a ^ b for a, b in zip(data[i : i + 16], start, strict=True)))
        out += start
    return bytes(out)


def _hash(password: bytes, salt: bytes, revision: int) -> bytes:
    """The hash of revisions 5 (SHA-256) and 6 (rounds of AES and a SHA-2 that what comes out picks)."""
    k = hashlib.sha256(password + salt).digest()
    if revision < 6:
        return k
    n = 0
    while True:
        e = cbc_encrypt(k[:16], (password + k) * 64, k[16:32])
        k = hashlib.new(("sha256", "sha384", "sha512")[sum(e[:16]) % 3], e).digest()
        n += 1
        if n >= 64 and e[-1] <= n - 32:
            return k[:32]


class Security:
    """Decrypts strings and streams of objects; ValueError where the empty password does not open the file."""

    def __init__(self, entry: dict, first_id: bytes):
        number = lambda k, default: v if isinstance(v := entry.get(k), int) else default
        raw = lambda k: v if isinstance(v := entry.get(k), bytes) else b""
        if entry.get("Filter") not in (None, "Standard"):
            raise ValueError("The PDF is locked by a security handler that is not the standard one.")
        version, revision = number("V", 0), number("R", 2)
        self.metadata = entry.get("EncryptMetadata") is not False
        length = max(5, min(16, number("Length", 40) // 8))
        methods = {}
        for use in ("StmF", "StrF"):
            named = (entry.get("CF") or {}).get(entry.get(use, "Identity")) or {}
            methods[use] = {"V2": "rc4", "AESV2": "aes", "AESV3": "aes"}.get(named.get("CFM"), "none")
        self.streams, self.strings = (methods["StmF"], methods["StrF"]) if version >= 4 else ("rc4", "rc4")
        self.whole = version >= 5
        if self.whole:
            user = raw("U")
            if _hash(b"", user[32:40], revision) != user[:32]:
                raise ValueError("The PDF opens with a password only.")
            self.key = cbc_decrypt(_hash(b"", user[40:48], revision), raw("UE")[:32], bytes(16))
            return
        length = 5 if revision < 3 else 16 if version >= 4 else length
        rights = (number("P", 0) & 0xFFFFFFFF).to_bytes(4, "little")
        key = hashlib.md5(PAD + raw("O")[:32] + rights + first_id + (b"\xff" * 4 if revision >= 4 and not self.metadata else b"")).digest()
        for _ in range(50 if revision >= 3 else 0):
            key = hashlib.md5(key[:length]).digest()
        self.key = key[:length]
        if revision < 3:
            opens = rc4(self.key, PAD) == raw("U")[:32]
        else:
            proof = hashlib.md5(PAD + first_id).digest()
            for i in range(20):
                proof = rc4(bytes(b ^ i for b in self.key), proof)
            opens = proof == raw("U")[:16]
        if not opens:
            raise ValueError("The PDF opens with a password only.")

    def open(self, data: bytes, number: int, generation: int, stream: bool) -> bytes:
        method = self.streams if stream else self.strings
        if method == "none":
            return data
        key = self.key
        if not self.whole:
            key = hashlib.md5(key + number.to_bytes(4, "little")[:3] + generation.to_bytes(4, "little")[:2] + (b"sAlT" if method == "aes" else b"")).digest()[: min(16, len(key) + 5)]
        return rc4(key, data) if method == "rc4" else cbc_decrypt(key, data)
