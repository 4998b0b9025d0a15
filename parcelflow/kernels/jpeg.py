"""A baseline JPEG writer, and the orientation that a picture's camera noted. Decoding is the JVM's (pictures.load)."""

from __future__ import annotations

import struct

import numpy as np

_ZIGZAG = np.array(sorted(range(64), key=lambda k: (s := k // 8 + k % 8, k // 8 if s % 2 else k % 8)))
_LUMA = np.array(
    "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99".split(), float
)
_CHROMA = np.full(64, 99.0)
_CHROMA[[0, 1, 2, 3, 8, 9, 10, 11, 16, 17, 18, 24, 25]] = [17, 18, 24, 47, 18, 21, 26, 66, 24, 26, 56, 47, 66]
_DCT = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _codes(lengths: list[int], symbols: bytes) -> dict[int, tuple[int, int]]:
    out, code, k = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[symbols[k]] = (code, n)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _best_codes(counts: np.ndarray) -> tuple[list[int], bytes]:
    """Code lengths (at most 16) and symbols of a Huffman code for these counts; no code is all ones."""
    import heapq

    heap = [(int(c), s, [s]) for s, c in enumerate(counts) if c] + [(0, 256, [256])]  # the last stands for all ones
    heapq.heapify(heap)
    size = dict.fromkeys([s for _, s, _ in heap], 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            size[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    per = [0] * 64
    for n in size.values():
        per[max(n, 1)] += 1
    for n in range(63, 16, -1):  # too long ones pair up, a shorter one makes room
        while per[n] > 0:
            j = n - 2
            while not per[j]:
                j -= 1
            per[n] -= 2
            per[n - 1] += 1
            per[j + 1] += 2
            per[j] -= 1
    last = max(n for n in range(17) if per[n])
    per[last] -= 1
    order = sorted((s for s in size if s < 256), key=lambda s: (size[s], s))
    return per[1:17], bytes(order)


def encode(px: np.ndarray, quality: int = 85) -> bytes:
    """A JPEG of height x width (grey) or height x width x 3 (RGB) pixels of 8 bits; colours at full resolution."""
    px = np.asarray(px, np.uint8)
    h, w = px.shape[:2]
    if px.ndim == 2 or px.shape[2] == 1:
        planes = [px.reshape(h, w).astype(float)]
    else:
        r, g, b = (px[..., k].astype(float) for k in range(3))
        planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    tables = [np.clip(np.floor((t * scale + 50) / 100), 1, 255) for t in ((_LUMA,) if len(planes) == 1 else (_LUMA, _CHROMA))]
    blocks = []
    for k, p in enumerate(planes):
        p = np.pad(p, ((0, -h % 8), (0, -w % 8)), "edge") - 128
        b = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        c = (_DCT @ b @ _DCT.T).reshape(-1, 64)
        blocks.append(np.rint(c / tables[min(k, 1)]).astype(int)[:, _ZIGZAG])
    stream = []  # (table, whether ac, symbol, bits, number of bits)
    before = [0] * len(planes)
    for n in range(len(blocks[0])):
        for k, plane in enumerate(blocks):
            z, t = plane[n], min(k, 1)
            stream.append((t, 0, *_bits(int(z[0]) - before[k], 0)))
            before[k] = int(z[0])
            run = 0
            for at in np.flatnonzero(z[1:]).tolist():
                v, zeros = int(z[at + 1]), at - run
                while zeros > 15:
                    stream.append((t, 1, 0xF0, 0, 0))
                    zeros -= 16
                stream.append((t, 1, *_bits(v, zeros)))
                run = at + 1
            if run < 63:
                stream.append((t, 1, 0, 0, 0))
    out = [b"\xff\xd8", _part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    out += [_part(0xDB, bytes([k]) + bytes(t[_ZIGZAG].astype(np.uint8))) for k, t in enumerate(tables)]
    out.append(_part(0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([k + 1, 0x11, min(k, 1)]) for k in range(len(planes)))))
    codes = {}
    for t in range(len(tables)):
        for ac in (0, 1):
            lengths, order = _best_codes(np.bincount([s for a, c, s, *_ in stream if (a, c) == (t, ac)], minlength=256))
            codes[t, ac] = _codes(lengths, order)
            out.append(_part(0xC4, bytes([ac << 4 | t, *lengths]) + order))
    out.append(_part(0xDA, bytes([len(planes)]) + b"".join(bytes([k + 1, min(k, 1) * 0x11]) for k in range(len(planes))) + b"\0\x3f\0"))
    body, held, n = bytearray(), 0, 0
    for t, ac, s, v, size in stream:
        code, length = codes[t, ac][s]
        held = (held << length | code) << size | v
        n += length + size
        while n >= 8:
            n -= 8
            x = held >> n
            held &= (1 << n) - 1
            body.append(x)
            if x == 255:
                body.append(0)
    if n:
        x = held << (8 - n) | (1 << (8 - n)) - 1
        body += bytes([x, 0] if x == 255 else [x])
    return b"".join(out) + bytes(body) + b"\xff\xd9"


def _bits(v: int, zeros: int) -> tuple[int, int, int]:
    n = abs(v).bit_length()
    return zeros << 4 | n, v if v >= 0 else v + (1 << n) - 1, n


def _part(mark: int, body: bytes) -> bytes:
    return bytes([255, mark]) + struct.pack(">H", len(body) + 2) + body


def orientation(data: bytes) -> int:
    """1 to 8, by the camera's notes in a JPEG's head; 1 where there are none."""
    if data[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 <= len(data) and data[at] == 255 and data[at + 1] != 0xDA:
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            t = data[at + 10 : at + 2 + n]
            e = {b"II": "<", b"MM": ">"}.get(t[:2])
            try:
                start = struct.unpack(e + "I", t[4:8])[0]
                for k in range(struct.unpack(e + "H", t[start : start + 2])[0]):
                    tag, _, _, v = struct.unpack(e + "HHIH", t[start + 2 + 12 * k : start + 12 + 12 * k])
                    if tag == 274:
                        return v if 1 <= v <= 8 else 1
            except (struct.error, TypeError):
                return 1
        at += 2 + n
    return 1


def upright(px: np.ndarray, kind: int) -> np.ndarray:
    """Pixels turned as their orientation asks."""
    px = px if kind < 5 else px.swapaxes(0, 1)
    turn = {2: (1, -1), 3: (-1, -1), 4: (-1, 1), 6: (1, -1), 7: (-1, -1), 8: (-1, 1)}.get(kind, (1, 1))
    return px[:: turn[0], :: turn[1]]
