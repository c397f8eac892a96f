"""AES in pure Python, for members read inside Python tasks.  Tables are computed from the field's rules."""

from __future__ import annotations


def _double(a: int) -> int:
    a <<= 1
    return a ^ 0x11B if a & 256 else a


def _tables() -> tuple[list[int], list[int]]:
    """The substitution box and its inverse: field inverses under the affine map."""
    box, p, q = [0] * 256, 1, 1
    while True:
        p ^= _double(p)  # p runs through powers of 3, q through those of its inverse
        for shift in (1, 2, 4):
            q ^= q << shift & 0xFF
        if q & 0x80:
            q ^= 9
        x = q
        for r in (1, 2, 3, 4):
            x ^= (q << r | q >> (8 - r)) & 0xFF
        box[p] = x ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    back = [0] * 256
    for i, v in enumerate(box):
        back[v] = i
    return box, back


BOX, BACK = _tables()


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a, b = _double(a), b >> 1
    return out


MUL = {k: [_times(i, k) for i in range(256)] for k in (2, 3, 9, 11, 13, 14)}


def round_keys(key: bytes) -> list[list[int]]:
    words = [list(key[i : i + 4]) for i in range(0, len(key), 4)]
    n, constant = len(words), 1
    for i in range(n, 4 * (n + 7)):
        w = list(words[-1])
        if i % n == 0:
            w = [BOX[b] for b in w[1:] + w[:1]]
            w[0] ^= constant
            constant = _double(constant)
        elif n > 6 and i % n == 4:
            w = [BOX[b] for b in w]
        words.append([a ^ b for a, b in zip(words[i - n], w)])
    return [sum(words[i : i + 4], []) for i in range(0, len(words), 4)]


def encrypt_block(block: bytes, keys: list[list[int]]) -> bytes:
    s = [a ^ b for a, b in zip(block, keys[0])]
    two, three = MUL[2], MUL[3]
    for k in keys[1:-1]:
        s = [BOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
        s = [
            two[s[c + r]] ^ three[s[c + (r + 1) % 4]] ^ s[c + (r + 2) % 4] ^ s[c + (r + 3) % 4] ^ k[c + r] for c in (0, 4, 8, 12) for r in range(4)
        ]
    return bytes(BOX[s[(i + 4 * (i % 4)) % 16]] ^ keys[-1][i] for i in range(16))


def decrypt_block(block: bytes, keys: list[list[int]]) -> bytes:
    s = [a ^ b for a, b in zip(block, keys[-1])]
    e, b, d, n = MUL[14], MUL[11], MUL[13], MUL[9]
    for k in keys[-2:0:-1]:
        s = [BACK[s[(i - 4 * (i % 4)) % 16]] ^ k[i] for i in range(16)]
        s = [e[s[c + r]] ^ b[s[c + (r + 1) % 4]] ^ d[s[c + (r + 2) % 4]] ^ n[s[c + (r + 3) % 4]] for c in (0, 4, 8, 12) for r in range(4)]
    return bytes(BACK[s[(i - 4 * (i % 4)) % 16]] ^ keys[0][i] for i in range(16))


def ctr_little_endian(data: bytes, key: bytes) -> bytes:
    """The counter starts at one, least byte first, as WinZip's AES has it."""
    keys, out = round_keys(key), bytearray()
    for i in range(0, len(data), 16):
        pad = encrypt_block((i // 16 + 1).to_bytes(16, "little"), keys)
        out += bytes(a ^ b for a, b in zip(data[i : i + 16], pad))
    return bytes(out)


def cbc_decrypt(data: bytes, key: bytes, iv: bytes) -> bytes:
    keys, out = round_keys(key), bytearray()
    for i in range(0, len(data), 16):
        block = data[i : i + 16]
        out += bytes(a ^ b for a, b in zip(decrypt_block(block, keys), iv))
        iv = block
    return bytes(out)
