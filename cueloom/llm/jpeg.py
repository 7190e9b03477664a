"""Baseline JPEG frames: a lossless container for bytes, and a decoder.

A payload byte is one quantised coefficient of size category 8: its 256 values carry the byte as
their 8 extra bits. With one-bit codes and a restart after each block, a block of 64 bytes takes
exactly 72 bytes, so whole arrays of blocks are written and read at once.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

SIDE = 32
BLOCKS = (SIDE // 8) ** 2
FRAME_BYTES = BLOCKS * 64
#: Frames written or read at a time: about 30 bytes are held for each byte of them.
RUN = 1024

#: Row-major place of each coefficient in zigzag order: along the diagonals, turning at each end.
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])
_k, _n = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
_DCT = np.cos((2 * _n + 1) * _k * np.pi / 16) * np.where(_k == 0, np.sqrt(1 / 8), np.sqrt(2 / 8))
#: From row-major coefficients to row-major pixels.
_INVERSE = np.einsum("ux,vy->uvxy", _DCT, _DCT).reshape(64, 64).astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLE = bytes([1, *[0] * 15, 8])
HEAD = (
    b"\xff\xd8" + _segment(0xE0, b"AVI1" + bytes(10)) + _segment(0xDB, b"\0" + b"\1" * 64)
    + _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\1\x11\0")
    + _segment(0xC4, b"\0" + _TABLE) + _segment(0xC4, b"\x10" + _TABLE) + _segment(0xDD, b"\0\1") + _segment(0xDA, b"\1\1\0\0\x3f\0")
)


def write_frames(payload: np.ndarray, run: int = RUN) -> list[bytes]:
    """JPEG frames that hold the payload, padded with 0 to whole frames; ``run`` frames are built at a time."""
    size = run * FRAME_BYTES
    return [f for i in range(0, max(len(payload), 1), size) for f in _write_run(payload[i : i + size])]


def _write_run(payload: np.ndarray) -> list[bytes]:
    frames = max(1, -(-len(payload) // FRAME_BYTES))
    data = np.zeros(frames * FRAME_BYTES, np.uint8)
    data[: len(payload)] = payload
    bits = np.zeros((len(data) // 64, 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(data).reshape(-1, 64, 8)
    blocks = np.zeros((len(bits), 74), np.uint8)
    blocks[:, :72] = np.packbits(bits.reshape(-1, 576), axis=1)
    times = np.ones(blocks.shape, np.int64)
    times[:, :72] += blocks[:, :72] == 0xFF
    blocks[:, 72] = 0xFF
    place = np.arange(len(blocks)) % BLOCKS
    blocks[:, 73] = np.where(place == BLOCKS - 1, 0xD9, 0xD0 + place % 8)
    flat, times = blocks.reshape(-1), times.reshape(-1)
    out = np.repeat(flat, times)
    out[np.cumsum(times)[times == 2] - 1] = 0
    stops = np.cumsum(times.reshape(frames, -1).sum(axis=1)).tolist()
    raw = out.tobytes()
    return [HEAD + raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]


class Scan(NamedTuple):
    """A frame's parameters and its entropy-coded bytes."""

    height: int
    width: int
    parts: list[tuple[int, int, int, int]]  # id, horizontal, vertical sampling, quantiser
    quantisers: dict[int, np.ndarray]
    codes: dict[int, bytes]
    tables: dict[int, tuple[int, int]]
    restart: int
    data: bytes


def parse(frame: bytes) -> Scan:
    """Read the segments of a baseline JPEG."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, quantisers, codes, restart, shape = 2, {}, {}, 0, None
    while True:
        marker, n = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body, at = frame[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int32)
                body = body[1 + 64 * wide :]
        elif marker in (0xC0, 0xC1):
            depth, height, width, count = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("only 8-bit samples")
            shape = height, width, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames")
        elif marker == 0xC4:
            while body:
                m = 17 + sum(body[1:17])
                codes[body[0]] = body[1:m]
                body = body[m:]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, 16 + (body[2 + 2 * i] & 15)) for i in range(body[0])}
            end = frame.rfind(b"\xff\xd9")
            return Scan(*shape, quantisers, codes, tables, restart, frame[at : end if end >= at else len(frame)])


def read_frames(frames: list[bytes]) -> np.ndarray | None:
    """Payload bytes [block, 64] of frames that ``write_frames`` made, or None if any is another kind."""
    if not all(f.startswith(HEAD) and f.endswith(b"\xff\xd9") for f in frames):
        return None
    flat = np.frombuffer(b"".join(f[len(HEAD) :] for f in frames), np.uint8)
    full = np.flatnonzero(flat[:-1] == 0xFF)
    stuffed = full[flat[full + 1] == 0] + 1
    flat = np.delete(flat, stuffed)
    if len(flat) != len(frames) * BLOCKS * 74:
        return None
    bits = np.unpackbits(np.ascontiguousarray(flat.reshape(-1, 74)[:, :72]), axis=1).reshape(-1, 64, 9)
    if bits[:, :, 0].any():
        return None
    return np.packbits(np.ascontiguousarray(bits[:, :, 1:]).reshape(-1, 512), axis=1)


def coefficients(blocks: np.ndarray) -> np.ndarray:
    """The coefficients, in zigzag order, that payload bytes stand for."""
    wide = blocks.astype(np.int16)
    return np.where(wide >= 128, wide, wide - 255)


def pixels(zigzag: np.ndarray) -> np.ndarray:
    """Samples [block, 8 * 8] of dequantised coefficients in zigzag order."""
    rows = np.zeros(zigzag.shape, np.float32)
    rows[:, ZIGZAG] = zigzag
    return np.clip(np.rint(rows @ _INVERSE + 128), 0, 255).astype(np.uint8)


def _lookup(code: bytes) -> dict[tuple[int, int], int]:
    out, value, k = {}, 0, 16
    for n in range(1, 17):
        for _ in range(code[n - 1]):
            out[n, value] = code[k]
            value, k = value + 1, k + 1
        value <<= 1
    return out


def decode(frame: bytes) -> np.ndarray:
    """The first component (luma) of any baseline frame as [height, width] samples."""
    s = parse(frame)
    tables = {i: _lookup(c) for i, c in s.codes.items()}
    most_h, most_v = max(p[1] for p in s.parts), max(p[2] for p in s.parts)
    alone = len(s.parts) == 1
    if alone:
        most_h = most_v = 1
    across, down = -(-s.width // (8 * most_h)), -(-s.height // (8 * most_v))
    plan = [(i, h, v) for i, (_, h, v, _) in enumerate(s.parts)] if not alone else [(0, 1, 1)]
    segments, begin, i = [], 0, 0
    while i < len(s.data) - 1:
        if s.data[i] == 0xFF and 0xD0 <= s.data[i + 1] <= 0xD7:
            segments.append(s.data[begin:i])
            begin = i = i + 2
        else:
            i += 1
    segments.append(s.data[begin:])
    h0, v0 = plan[0][1:]
    luma = np.zeros((down * v0, across * h0, 64), np.int32)
    unit, total = 0, across * down
    for data in segments:
        bits = int.from_bytes(b"\1" + data.replace(b"\xff\0", b"\xff"), "big")
        text, at = bin(bits)[3:], 0
        before = [0] * len(s.parts)
        for _ in range(min(s.restart or total, total - unit)):
            my, mx = divmod(unit, across)
            for i, h, v in plan:
                dc, ac = s.tables[s.parts[i][0]]
                for y in range(v):
                    for x in range(h):
                        block, k = [0] * 64, 0
                        while k < 64:
                            table, n = tables[ac if k else dc], 1
                            while (n, int(text[at : at + n], 2)) not in table:
                                n += 1
                                if n > 16:
                                    raise ValueError("bad code")
                            symbol, at = table[n, int(text[at : at + n], 2)], at + n
                            run, size = divmod(symbol, 16)
                            if k and not size:
                                if run < 15:
                                    break
                                k += 16
                                continue
                            extra = int(text[at : at + size], 2) if size else 0
                            at += size
                            value = extra if not size or extra >> (size - 1) else extra - (1 << size) + 1
                            if not k:
                                before[i] += value
                                block[0] = before[i]
                            else:
                                k += run
                                block[k] = value
                            k += 1
                        if i == 0:
                            luma[my * v + y, mx * h + x] = block
            unit += 1
    samples = pixels(luma.reshape(-1, 64) * s.quantisers[s.parts[0][3]]).reshape(*luma.shape[:2], 8, 8)
    return samples.transpose(0, 2, 1, 3).reshape(luma.shape[0] * 8, luma.shape[1] * 8)[: s.height, : s.width]
