"""Encrypted PDF files, made in memory and opened with the empty password."""

import hashlib

import pytest

from foliospark.parse import crypt
from foliospark.parse.convert import run
from foliospark.parse.office import Options
from foliospark.sources import samples

OWNER, ID, RIGHTS = bytes(range(32)), b"sixteen bytes id", -44


def literal(data: bytes) -> str:
    return "<" + data.hex() + ">"


def of_object(key: bytes, salt: bytes = b"") -> bytes:
    return hashlib.md5(key + b"\x04\0\0\0\0" + salt).digest()[: min(16, len(key) + 5)]


def padded(data: bytes) -> bytes:
    n = 16 - len(data) % 16
    return data + bytes([n]) * n


def locked(revision: int, spoil: bool = False):
    def encrypt(stream: bytes) -> tuple[bytes, str]:
        common = f"/Filter/Standard/R {revision}/P {RIGHTS}/O {literal(OWNER)}"
        if revision >= 5:
            key, proof, salt = bytes(range(100, 132)), b"validate", b"key salt"
            user = crypt._hash(b"", proof, revision) + proof + salt
            wrapped = crypt.cbc_encrypt(crypt._hash(b"", salt, revision), key, bytes(16))
            user = bytes(48) if spoil else user
            entry = f"/V 5/Length 256/U {literal(user)}/UE {literal(wrapped)}/CF<</StdCF<</CFM/AESV3>>>>/StmF/StdCF/StrF/StdCF"
            start = bytes(range(16))
            return start + crypt.cbc_encrypt(key, padded(stream), start), f"/Encrypt<<{common}{entry}>>"
        length = 5 if revision == 2 else 16
        key = hashlib.md5(crypt.PAD + OWNER + (RIGHTS & 0xFFFFFFFF).to_bytes(4, "little") + ID).digest()
        for _ in range(0 if revision == 2 else 50):
            key = hashlib.md5(key[:length]).digest()
        key = key[:length]
        user = crypt.rc4(key, crypt.PAD)
        if revision > 2:
            user = hashlib.md5(crypt.PAD + ID).digest()
            for i in range(20):
                user = crypt.rc4(bytes(b ^ i for b in key), user)
            user += bytes(16)
        user = bytes(32) if spoil else user
        common += f"/U {literal(user)}"
        tail = f"/ID[{literal(ID)}{literal(ID)}]"
        if revision < 4:
            return crypt.rc4(of_object(key), stream), f"/Encrypt<<{common}/V {revision - 1}/Length {8 * length}>>{tail}"
        start = bytes(range(16, 32))
        body = start + crypt.cbc_encrypt(of_object(key, b"sAlT"), padded(stream), start)
        return body, f"/Encrypt<<{common}/V 4/Length 128/CF<</StdCF<</CFM/AESV2/Length 16>>>>/StmF/StdCF/StrF/StdCF>>{tail}"

    return encrypt


@pytest.mark.parametrize("revision", [2, 3, 4, 5, 6])
def test_the_empty_password_opens(revision):
    got = run("locked.pdf", samples.pdf("Tide tables", ["High water is at nine."], locked(revision)), Options())
    assert got["error"] is None and got["markdown"] == "# Tide tables\n\nHigh water is at nine.\n"


@pytest.mark.parametrize("revision", [2, 4, 6])
def test_other_passwords_are_refused(revision):
    assert "password" in run("locked.pdf", samples.pdf("Tide tables", ["High"], locked(revision, spoil=True)), Options())["error"]


def test_known_vectors():
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for size, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        aes = crypt.Aes(bytes(range(size)))
        assert aes.encrypt(plain).hex() == want and aes.decrypt(bytes.fromhex(want)) == plain
    assert crypt.rc4(b"Wiki", b"pedia").hex() == "1021bf0420"
