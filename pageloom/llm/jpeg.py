"""Baseline JPEG in numpy: a decoder for the frames of motion-JPEG, and an encoder for test media.

The decoder reads sequential 8-bit Huffman images (SOF0, SOF1) of one or three
components with any sampling factors and with restart intervals.  Frames without
Huffman tables, as cameras write them into AVI, use the standard's own (ITU T.81,
annex K).  Frames are decoded side by side: each step of entropy decoding takes one
symbol of every frame (and of every restart interval), and dequantisation, inverse
DCT and colour planes are made for all frames of one form at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np


See = Callable[[np.ndarray], Sequence]


class JpegError(ValueError):
    """The bytes are no image that this decoder reads."""


def _zigzag() -> np.ndarray:
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (s := p[0] + p[1], p[0] if s % 2 else p[1]))
    return np.array([y * 8 + x for y, x in order])


ZIGZAG = _zigzag()
_K = np.arange(8)
_DCT = np.sqrt(np.where(_K == 0, 1, 2) / 8)[:, None] * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)
_DCT32 = _DCT.astype(np.float32)


def _annex_k(counts: str, symbols: str) -> tuple[bytes, bytes]:
    return bytes.fromhex(counts), bytes.fromhex(symbols)


_AC_LUMA = (
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
    "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9ca"
    "d2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)
_AC_CHROMA = (
    "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a"
    "535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9ca"
    "d2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
).replace(" ", "")
#: By (class, id): symbols of each code length, and the symbols.
STANDARD = {
    (0, 0): _annex_k("00010501010101010100000000000000", "000102030405060708090a0b"),
    (0, 1): _annex_k("00030101010101010101010000000000", "000102030405060708090a0b"),
    (1, 0): _annex_k("0002010303020403050504040000017d", _AC_LUMA),
    (1, 1): _annex_k("00020102040403040705040400010277", _AC_CHROMA),
}


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(code, length, symbol), in the order of the codes."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length, symbols[k]))
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(64)
def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For the next 16 bits: length << 8 | symbol; 0 where no code begins so."""
    table = np.zeros(1 << 16, np.int32)
    for code, length, symbol in _codes(counts, symbols):
        if code >> length:
            raise JpegError("overfull Huffman table")
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return table


def _scan(pieces: list[tuple[bytes, int, int]], plan: list[tuple[int, int, int]], tables: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The coefficients of all blocks, in zigzag order, and which pieces are broken.

    A piece is entropy-coded bytes, its first block and its number of MCUs.  ``plan``
    has for each block of an MCU the component and its tables' places in ``tables``.
    """
    out = np.zeros(blocks * 64, np.int16)
    n = len(pieces)
    ends = np.cumsum([len(p[0]) + 8 for p in pieces])
    data = np.frombuffer(b"".join(p[0] + bytes(8) for p in pieces), np.uint8)
    bad = np.zeros(n, bool)
    component, dc, ac = (np.array([p[k] for p in plan]) for k in range(3))
    flat = tables.ravel()
    # of the pieces at work: number, next bit, last bit, block, last block, block of the MCU, coefficient, predictors
    live = np.arange(n)
    bit = (ends - np.array([len(p[0]) + 8 for p in pieces])) * 8
    last = (ends - 8) * 8
    block = np.array([p[1] for p in pieces], np.int64)
    stop = block + np.array([p[2] for p in pieces], np.int64) * len(plan)
    turn, k = np.zeros(n, np.int64), np.zeros(n, np.int64)
    before = np.zeros((n, int(component.max()) + 1), np.int64)
    while len(live):
        at = bit >> 3
        window = np.zeros(len(live), np.int64)
        for i in range(5):
            window = window << 8 | data[at + i]
        room = 40 - (bit & 7)
        first = k == 0
        code = flat[np.where(first, dc[turn], ac[turn]) << 16 | window >> (room - 16) & 0xFFFF]
        bits = code & 15
        room = room - (code >> 8) - bits
        bit = bit + (code >> 8) + bits
        value = window >> room & (1 << bits) - 1
        value = np.where(value < 1 << bits >> 1, value - (1 << bits) + 1, value)
        zeros = np.where(first, 0, code >> 4 & 15)
        end = ~first & (code & 255 == 0)
        k = k + zeros
        wrong = (code == 0) | (bit > last) | (k > 63) & ~end
        if first.any():
            c = component[turn[first]]
            rows = np.flatnonzero(first)
            value[first] += before[rows, c]
            before[rows, c] = value[first]
        put = ~wrong & ((bits > 0) | first)
        out[(block[put] << 6) + k[put]] = value[put]
        k = k + 1
        over = end | (k > 63)
        if over.any() or wrong.any():
            k[over] = 0
            block = block + over
            turn = np.where(over, turn + 1, turn)
            turn[turn == len(plan)] = 0
            done = wrong | (block >= stop)
            if done.any():
                bad[live[wrong]] = True
                on = ~done
                live, bit, last, block, stop, turn, k, before = (x[on] for x in (live, bit, last, block, stop, turn, k, before))
    return out.reshape(-1, 64), bad


def _restart_pieces(data: bytes) -> list[bytes]:
    """The entropy-coded bytes between restart markers, without stuffing, up to the next other marker."""
    pieces, at, begin = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        marker = data[at + 1] if 0 <= at < len(data) - 1 else None
        if marker is None or not (marker in (0, 0xFF) or 0xD0 <= marker <= 0xD7):
            pieces.append(data[begin : at if at >= 0 else len(data)].replace(b"\xff\0", b"\xff"))
            return pieces
        if 0xD0 <= marker <= 0xD7:
            pieces.append(data[begin:at].replace(b"\xff\0", b"\xff"))
            begin = at + 2
        at += 1 if marker == 0xFF else 2


@dataclass(frozen=True)
class _Form:
    """What frames must have in common to be decoded at once."""

    height: int
    width: int
    parts: tuple[tuple[int, int], ...]  # sampling factors of each component
    quants: tuple[bytes, ...]
    tables: tuple[tuple[tuple[bytes, bytes], tuple[bytes, bytes]], ...]  # of each component: DC and AC


def _parse(data: bytes) -> tuple[_Form, bytes, int]:
    """The form of an image, its entropy-coded bytes and its restart interval."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    quant: dict[int, bytes] = {}
    huffman = dict(STANDARD)
    frame, interval, at = None, 0, 2
    while True:
        while at < len(data) and data[at] != 0xFF:
            at += 1
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at + 3 > len(data):
            raise JpegError("no scan")
        marker, size = data[at], int.from_bytes(data[at + 1 : at + 3], "big")
        body = data[at + 3 : at + 1 + size]
        at += 1 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide, name = body[k] >> 4, body[k] & 15
                n = 128 if wide else 64
                if len(body) < k + 1 + n:
                    raise JpegError("short quantisation table")
                quant[name] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.float32).tobytes()
                k += 1 + n
        elif marker == 0xC4:
            k = 0
            while k + 17 <= len(body):
                counts = body[k + 1 : k + 17]
                huffman[body[k] >> 4, body[k] & 15] = (counts, body[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker in (0xC0, 0xC1):
            if len(body) < 6 or len(body) < 6 + 3 * body[5]:
                raise JpegError("short frame header")
            frame = (body[0], int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])])
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
            raise JpegError("not a baseline image")
        elif marker == 0xD9:
            raise JpegError("no scan")
        elif marker == 0xDA:
            break
    if frame is None or frame[0] != 8 or len(frame[3]) not in (1, 3) or not frame[1] * frame[2]:
        raise JpegError("not an 8-bit image of one or three components")
    _, height, width, parts = frame
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    if not body or body[0] != len(parts) or len(body) < 1 + 2 * len(parts) or any(not 1 <= h <= 4 or not 1 <= v <= 4 for _, h, v, _ in parts):
        raise JpegError("several scans")
    chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(len(parts))}
    if any(name not in chosen or q not in quant or (0, chosen[name] >> 4) not in huffman or (1, chosen[name] & 15) not in huffman for name, _, _, q in parts):
        raise JpegError("a table is missing")
    tables = tuple((huffman[0, chosen[p[0]] >> 4], huffman[1, chosen[p[0]] & 15]) for p in parts)
    return _Form(height, width, tuple((h, v) for _, h, v, _ in parts), tuple(quant[p[3]] for p in parts), tables), data[at:], interval


def _decode_form(form: _Form, scans: list[tuple[bytes, int]], see: See) -> list:
    """What ``see`` makes of the frames of one form, from their entropy-coded bytes and restart intervals."""
    most_h, most_v = (max(p[k] for p in form.parts) for k in (0, 1))
    across, down = -(-form.width // (8 * most_h)), -(-form.height // (8 * most_v))
    if any(most_h % h or most_v % v for h, v in form.parts):
        return [JpegError("uneven sampling factors")] * len(scans)
    names = list(dict.fromkeys(t for pair in form.tables for t in pair))
    try:
        tables = np.stack([_lookup(*t) for t in names])
    except (JpegError, IndexError):
        return [JpegError("no such Huffman table")] * len(scans)
    plan = [(c, names.index(dc), names.index(ac)) for c, ((h, v), (dc, ac)) in enumerate(zip(form.parts, form.tables)) for _ in range(h * v)]
    mcus, each = across * down, len(plan)
    pieces, owner, short = [], [], np.zeros(len(scans), bool)
    for f, (data, interval) in enumerate(scans):
        done = 0
        for piece in _restart_pieces(data):
            if done < mcus:
                n = min(interval or mcus, mcus - done)
                pieces.append((piece, (f * mcus + done) * each, n))
                owner.append(f)
                done += n
        short[f] = done < mcus
    coefficients, bad = _scan(pieces, plan, tables, len(scans) * mcus * each)
    short[np.array(owner, np.int64)[bad]] = True
    coefficients = coefficients.reshape(len(scans), mcus, each, 64)
    planes, at = [], 0
    for (h, v), quant in zip(form.parts, form.quants):
        natural = np.zeros((len(scans), mcus * h * v, 64), np.float32)
        natural[..., ZIGZAG] = coefficients[:, :, at : at + h * v].reshape(len(scans), -1, 64) * np.frombuffer(quant, np.float32)
        at += h * v
        pixels = _DCT32.T @ natural.reshape(-1, 8, 8) @ _DCT32
        pixels = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8)
        plane = pixels.reshape(-1, down, across, v, h, 8, 8).transpose(0, 1, 3, 5, 2, 4, 6).reshape(-1, down * v * 8, across * h * 8)
        plane = plane.repeat(most_v // v, 1) if most_v > v else plane
        plane = plane.repeat(most_h // h, 2) if most_h > h else plane
        planes.append(plane[:, : form.height, : form.width])
    if len(planes) == 1:
        planes += [np.full_like(planes[0], 128)] * 2
    seen = see(np.stack(planes, -1))
    return [JpegError("the scan is broken") if short[f] else seen[f] for f in range(len(scans))]


#: Bytes of coefficients and pixels that are decoded at once.
_AT_ONCE = 64 << 20


def decode_all(frames: list[bytes], see: See = list) -> list:
    """Each image as YCbCr, (height, width, 3) uint8, or why it can't be read; grey images have chroma 128.

    ``see`` gets some images at once, (n, height, width, 3), and gives what to keep of each.
    """
    out: list = [JpegError("not decoded")] * len(frames)
    by_form: dict[_Form, list[tuple[int, bytes, int]]] = {}
    for i, data in enumerate(frames):
        try:
            form, scan, interval = _parse(data)
            by_form.setdefault(form, []).append((i, scan, interval))
        except JpegError as e:
            out[i] = e
    for form, own in by_form.items():
        step = max(1, _AT_ONCE // (12 * (form.height + 32) * (form.width + 32)))
        for p in range(0, len(own), step):
            some = own[p : p + step]
            for (i, _, _), image in zip(some, _decode_form(form, [(scan, interval) for _, scan, interval in some], see)):
                out[i] = image
    return out


def decode(data: bytes) -> np.ndarray:
    """One image as ``decode_all`` gives it."""
    if isinstance(image := decode_all([data])[0], JpegError):
        raise image
    return image


_QUANT = np.clip(3 + np.add.outer(_K, _K) * 2, 1, 255).reshape(64)


@lru_cache(4)
def _encoder(kind: int, name: int) -> dict[int, tuple[int, int]]:
    return {symbol: (code, length) for code, length, symbol in _codes(*STANDARD[kind, name])}


def _marker(kind: int, body: bytes) -> bytes:
    return bytes((0xFF, kind)) + (len(body) + 2).to_bytes(2, "big") + body


def encode(image: np.ndarray, interval: int = 0, tables: bool = True) -> bytes:
    """A baseline JPEG of a YCbCr image: 4:2:0, or one component for (height, width).

    ``interval`` is the restart interval in MCUs; without ``tables`` the Huffman
    tables are left out, as in AVI.
    """
    return encode_all(image[None], interval, tables)[0]


def encode_all(images: np.ndarray, interval: int = 0, tables: bool = True) -> list[bytes]:
    """A JPEG as of ``encode`` for each of several images of one size."""
    grey = images.ndim == 3
    n, height, width = images.shape[:3]
    step = 8 if grey else 16
    pad = ((0, 0), (0, -height % step), (0, -width % step)) + ((0, 0),) * (images.ndim - 3)
    full = (np.pad(images, pad, "edge") if any(b for _, b in pad) else images).astype(np.float32)
    across, down = full.shape[2] // step, full.shape[1] // step

    def blocks(plane: np.ndarray) -> np.ndarray:
        side = plane.shape[1] // down
        cut = plane.reshape(n, down, side // 8, 8, across, side // 8, 8).transpose(0, 1, 4, 2, 5, 3, 6).reshape(n, down * across, -1, 8, 8)
        return np.rint((_DCT @ (cut - 128) @ _DCT.T).reshape(*cut.shape[:3], 64)[..., ZIGZAG] / _QUANT[ZIGZAG]).astype(int)

    half = lambda p: p.reshape(n, p.shape[1] // 2, 2, p.shape[2] // 2, 2).mean((2, 4))
    planes = [blocks(full)] if grey else [blocks(full[..., 0]), blocks(half(full[..., 1])), blocks(half(full[..., 2]))]
    parts = [(1, 0x11, 0)] if grey else [(1, 0x22, 0), (2, 0x11, 0), (3, 0x11, 0)]
    head = b"\xff\xd8" + _marker(0xDB, b"\0" + _QUANT[ZIGZAG].astype(np.uint8).tobytes())
    head += _marker(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes((len(parts),)) + b"".join(map(bytes, parts)))
    if tables:
        head += b"".join(_marker(0xC4, bytes((kind << 4 | name,)) + counts + symbols) for (kind, name), (counts, symbols) in STANDARD.items())
    if interval:
        head += _marker(0xDD, interval.to_bytes(2, "big"))
    head += _marker(0xDA, bytes((len(parts),)) + b"".join(bytes((p[0], 0x11 * min(c, 1))) for c, p in enumerate(parts)) + b"\0\x3f\0")
    return [head + _entropy([p[f].tolist() for p in planes], interval) + b"\xff\xd9" for f in range(n)]


def _entropy(planes: list[list[list[list[int]]]], interval: int) -> bytes:
    """The entropy-coded bytes of the components' coefficients by MCU, block and place."""
    scan, acc, have = bytearray(), 0, 0
    before = [0] * len(planes)

    def flush() -> None:
        nonlocal acc, have
        fill = -have % 8
        raw = ((acc << fill) | ((1 << fill) - 1)).to_bytes((have + fill) // 8, "big")
        scan.extend(raw.replace(b"\xff", b"\xff\0"))
        acc = have = 0

    coders = [(_encoder(0, min(c, 1)), _encoder(1, min(c, 1))) for c in range(len(planes))]
    for m in range(len(planes[0])):
        if interval and m and m % interval == 0:
            flush()
            scan += bytes((0xFF, 0xD0 + (m // interval - 1) % 8))
            before = [0] * len(planes)
        for c, plane in enumerate(planes):
            dc, ac = coders[c]
            for block in plane[m]:
                places = [k for k in range(1, 64) if block[k]]
                last = 0
                for k in (0, *places):
                    value = block[k] - before[c] if k == 0 else block[k]
                    zeros = k - last - 1 if k else 0
                    while zeros > 15:
                        code, length = ac[0xF0]
                        acc, have, zeros = acc << length | code, have + length, zeros - 16
                    bits = abs(value).bit_length()
                    code, length = ac[zeros << 4 | bits] if k else dc[bits]
                    acc = (acc << length | code) << bits | (value if value > 0 else value + (1 << bits) - 1)
                    have += length + bits
                    last = k
                before[c] = block[0]
                if last < 63:
                    code, length = ac[0]
                    acc, have = acc << length | code, have + length
    flush()
    return bytes(scan)
