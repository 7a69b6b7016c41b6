"""Hashes, ciphers, compression and identifiers."""

from __future__ import annotations

from . import builtin, define

builtin("uuid crc32 md5 compress:mr_compress uncompress:mr_uncompress random_bytes:mr_random_bytes")


@define("sha", "sha1")
def sha1(s):
    return f"sha1({s})"


@define("sha2")
def sha2(s, bits):
    return f"if({bits} in (0, 224, 256, 384, 512), sha2({s}, {bits}), null)"


@define("to_base64")
def to_base64(s):
    return f"base64(cast({s} as binary))"


@define("from_base64")
def from_base64(s):
    return f"decode(try_to_binary({s}, 'base64'), 'UTF-8')"


def folded(key):
    """A key of any length as 16 bytes: its 16-byte blocks combined by exclusive or."""
    text = f"rpad(hex({key}), cast(ceil(greatest(octet_length({key}), 1) / 16.0) * 32 as int), '0')"
    blocks = f"transform(sequence(0, char_length({text}) div 32 - 1), b -> substring({text}, b * 32 + 1, 32))"
    half = lambda at: f"lpad(hex(aggregate({blocks}, 0L, (acc, b) -> acc ^ cast(conv(substring(b, {at}, 8), 16, 10) as bigint))), 8, '0')"
    return f"unhex(concat({half(1)}, {half(9)}, {half(17)}, {half(25)}))"


@define("aes_encrypt")
def aes_encrypt(s, key):
    """AES-128 in ECB mode with PKCS padding."""
    return f"aes_encrypt({s}, {folded(key)}, 'ECB', 'PKCS')"


@define("aes_decrypt")
def aes_decrypt(b, key):
    return f"decode(try_aes_decrypt({b}, {folded(key)}, 'ECB', 'PKCS'), 'UTF-8')"


@define("uncompressed_length")
def uncompressed_length(b):
    return f"cast(conv(hex(reverse(substring({b}, 1, 4))), 16, 10) as bigint)"


@define("uuid_short")
def uuid_short():
    return "monotonically_increasing_id()"
