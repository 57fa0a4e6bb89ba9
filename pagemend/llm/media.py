"""Progressive JPEG: a reader that accumulates scans into coefficient arrays, and a writer.

The reader takes Huffman-coded progressive (SOF2) files of one or three components with
8-bit samples: spectral selection and successive approximation, first and refining scans,
interleaved DC scans, restart intervals, runs of ended bands. Coefficients are kept in one
int32 array a component, transformed back in numpy, chroma is upsampled (three parts of the
nearer sample, one of the next), and the result is a full-resolution RGB tensor (height,
width, 3) of uint8.

Scans whose bits don't depend on Huffman decoding (DC refinements, and AC refinements in
which every coefficient is already set and one run covers the blocks) are read as bit
arrays; the rest goes symbol by symbol.

The writer stores a payload losslessly in the format's unit, the quantized coefficient: 64
bytes are one 8 x 8 block, byte b is the coefficient b + 256 in zig-zag order, all
quantizers are 1. A first DC scan and a first AC scan hold the value down to its ninth bit
(1 for all), and eight refining scans of DC and AC give a bit plane each. A file holds the
payload row by row as luma; with ``chroma`` two half-resolution planes of middle grey follow.
``text_media`` stores texts as files with chroma, reads them back, and gives the RGB tensor,
too, if asked for.

Defined cases: null text counts as empty, whose payload is 64 zero bytes; equal texts give
equal files; truncated or foreign files raise ValueError; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import reserved, tune

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))), np.int64)
_F = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
#: (64, 64): zig-zag coefficients to samples of a block.
INVERSE = np.einsum("xv,yu->xyvu", _F, _F).reshape(64, 64)[:, ZIGZAG].T.astype(np.float32)
MAX_SIDE = 65535 // 8
_MARKER = re.compile(b"\xff[^\x00]")
MAX_RUN = 32767
OFFSET = 256


# --- reading -----------------------------------------------------------------


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Bits:
    """Bits of one entropy-coded segment with stuffing removed."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff")
        self.at, self.end = 0, 8 * len(self.data)
        self._all: np.ndarray | None = None

    def bit(self) -> int:
        if self.at >= self.end:
            raise ValueError("scan data ends early")
        i = self.at
        self.at += 1
        return self.data[i >> 3] >> (7 - (i & 7)) & 1

    def take(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.bit()
        return out

    def block(self, n: int) -> np.ndarray:
        """The next n bits as an array."""
        if self.at + n > self.end:
            raise ValueError("scan data ends early")
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        bits = np.unpackbits(np.frombuffer(self.data, np.uint8, last - first, first))
        bits = bits[self.at & 7 : (self.at & 7) + n]
        self.at += n
        return bits

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bit()
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("bad Huffman code")


def _extend(v: int, n: int) -> int:
    return v if n == 0 or v >> (n - 1) else v - (1 << n) + 1


class Component:
    def __init__(self, ident: int, h: int, v: int, quant: int):
        self.ident, self.h, self.v, self.quant = ident, h, v, quant
        self.coef = np.zeros((0, 64), np.int32)
        self.wide = self.blocks_w = self.blocks_h = 0


class ProgressiveReader:
    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.quants: dict[int, np.ndarray] = {}
        self.dc: dict[int, dict] = {}
        self.ac: dict[int, dict] = {}
        self.parts: list[Component] = []
        self.restart = 0
        at = 2
        while True:
            if at + 2 > len(data) or data[at] != 0xFF:
                raise ValueError("marker expected")
            mark = data[at + 1]
            if mark == 0xD9:
                break
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if mark == 0xDB:
                self._quant(body)
            elif mark == 0xC4:
                self._huffman(body)
            elif mark == 0xC2:
                self._frame(body)
            elif mark == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif mark == 0xDA:
                at = self._scan(body, data, at)
            elif 0xC0 <= mark <= 0xCF and mark != 0xC8:
                raise ValueError("not a progressive Huffman file")

    def _quant(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, ident = body[at] >> 4, body[at] & 15
            n = 128 if wide else 64
            self.quants[ident] = np.frombuffer(body[at + 1 : at + 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
            at += 1 + n

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            kind, ident = body[at] >> 4, body[at] & 15
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            (self.ac if kind else self.dc)[ident] = _codes(counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def _frame(self, body: bytes) -> None:
        if body[0] != 8:
            raise ValueError("only 8-bit samples")
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        self.parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        self.hmax, self.vmax = max(p.h for p in self.parts), max(p.v for p in self.parts)
        self.mcus_w, self.mcus_h = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for p in self.parts:
            p.wide = self.mcus_w * p.h
            p.blocks_w, p.blocks_h = -(-self.width * p.h // (8 * self.hmax)), -(-self.height * p.v // (8 * self.vmax))
            p.coef = np.zeros((p.wide * self.mcus_h * p.v, 64), np.int32)
            p.order = (np.arange(p.blocks_h)[:, None] * p.wide + np.arange(p.blocks_w)).ravel()

    def _scan(self, head: bytes, data: bytes, at: int) -> int:
        n = head[0]
        by_id = {p.ident: p for p in self.parts}
        parts = [(by_id[head[1 + 2 * i]], head[2 + 2 * i] >> 4, head[2 + 2 * i] & 15) for i in range(n)]
        start, end, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        segments, end_at = self._segments(data, at)
        if n == 1:
            units = [(parts[0][0], parts[0][0].order)]
        else:
            units = []
            for p, _, _ in parts:
                my, mx, by, bx = np.ix_(np.arange(self.mcus_h), np.arange(self.mcus_w), np.arange(p.v), np.arange(p.h))
                units.append((p, ((my * p.v + by) * p.wide + mx * p.h + bx).reshape(self.mcus_h * self.mcus_w, -1)))
        total = len(units[0][1])
        step = self.restart or total
        for k, lo in enumerate(range(0, total, step)):
            if k >= len(segments):
                raise ValueError("scan data ends early")
            bits, hi = _Bits(segments[k]), min(lo + step, total)
            if start == 0:
                blocks = [(p, dc, o[lo:hi].reshape(hi - lo, -1)) for (p, dc, _), (_, o) in zip(parts, units, strict=True)]
                (self._dc_more if high else self._dc_first)(bits, blocks, low)
            else:
                p, _, ac = parts[0]
                (self._ac_more if high else self._ac_first)(bits, p, self.ac[ac], units[0][1][lo:hi], start, end, low)
        return end_at

    @staticmethod
    def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
        out = []
        while True:
            found = _MARKER.search(data, at)
            if not found:
                raise ValueError("file ends within a scan")
            out.append(data[at : found.start()])
            if not 0xD0 <= data[found.start() + 1] <= 0xD7:
                return out, found.start()
            at = found.start() + 2

    def _dc_first(self, bits: _Bits, blocks, low: int) -> None:
        before = [0] * len(blocks)
        if len(blocks) == 1 and blocks[0][2].shape[1] == 1 and self._dc_same(bits, blocks[0], low):
            return
        for m in range(len(blocks[0][2])):
            for i, (p, dc, order) in enumerate(blocks):
                for b in order[m]:
                    n = bits.symbol(self.dc[dc])
                    before[i] += _extend(bits.take(n), n)
                    p.coef[b, 0] = before[i] << low

    def _dc_same(self, bits: _Bits, block, low: int) -> bool:
        """One difference, then zeros of one bit each: read at once."""
        p, dc, order = block
        zero = [k for k, v in self.dc[dc].items() if v == 0]
        if not zero or zero[0] != (1, 0):
            return False
        at = bits.at
        n = bits.symbol(self.dc[dc])
        value = _extend(bits.take(n), n)
        if bits.at + len(order) - 1 > bits.end or bits.block(len(order) - 1).any():
            bits.at = at
            return False
        p.coef[order[:, 0], 0] = value << low
        return True

    def _dc_more(self, bits: _Bits, blocks, low: int) -> None:
        if len(blocks) == 1 and blocks[0][2].shape[1] == 1:
            p, _, order = blocks[0]
            p.coef[order[:, 0], 0] |= bits.block(len(order)).astype(np.int32) << low
            return
        width = sum(o.shape[1] for _, _, o in blocks)
        plane = bits.block(len(blocks[0][2]) * width).reshape(-1, width).astype(np.int32) << low
        at = 0
        for p, _, order in blocks:
            n = order.shape[1]
            p.coef[order.ravel(), 0] |= plane[:, at : at + n].ravel()
            at += n

    def _ac_first(self, bits: _Bits, p: Component, codes, order, start: int, end: int, low: int) -> None:
        if self._ac_same(bits, p, codes, order, start, end, low):
            return
        run = 0
        for b in order:
            if run:
                run -= 1
                continue
            k = start
            while k <= end:
                s = bits.symbol(codes)
                r, n = s >> 4, s & 15
                if n:
                    k += r
                    if k > end:
                        raise ValueError("coefficient beyond its band")
                    p.coef[b, k] = _extend(bits.take(n), n) << low
                    k += 1
                elif r == 15:
                    k += 16
                else:
                    run = (1 << r) + bits.take(r) - 1
                    break

    @staticmethod
    def _ac_same(bits: _Bits, p: Component, codes, order, start: int, end: int, low: int) -> bool:
        """Every coefficient the same symbol of one bit and the same bit of value: read at once."""
        if codes.get((1, 0)) != 1:
            return False
        n = 2 * len(order) * (end - start + 1)
        if bits.at + n > bits.end:
            return False
        at = bits.at
        pair = bits.block(n).reshape(-1, 2)
        if pair[:, 0].any():
            bits.at = at
            return False
        value = np.where(pair[:, 1], 1, -1).astype(np.int32).reshape(len(order), -1)
        p.coef[order, start : end + 1] = value * (1 << low)
        return True

    def _ac_more(self, bits: _Bits, p: Component, codes, order, start: int, end: int, low: int) -> None:
        one, i, band = 1 << low, 0, slice(start, end + 1)
        full = len(order) > 0 and p.coef[order, band].all()
        while i < len(order):
            b, k, run = order[i], start, 0
            while k <= end:
                s = bits.symbol(codes)
                r, n = s >> 4, s & 15
                value = 0
                if n == 0 and r < 15:
                    run = (1 << r) + bits.take(r)
                    break
                if n:
                    value = one if bits.bit() else -one
                while k <= end:
                    c = p.coef[b, k]
                    if c:
                        if bits.bit():
                            p.coef[b, k] = c + (one if c > 0 else -one)
                    else:
                        if r == 0:
                            if value:
                                p.coef[b, k] = value
                            k += 1
                            break
                        r -= 1
                    k += 1
            if not run:
                i += 1
                continue
            self._refine(bits, p, b, k, end, one)
            rest = order[i + 1 : i + run]
            i += run
            if full:
                if not len(rest):
                    continue
                rows = slice(rest[0], rest[-1] + 1) if rest[-1] - rest[0] == len(rest) - 1 else rest
                old = p.coef[rows, band]
                p.coef[rows, band] = old + np.sign(old) * (bits.block(old.size).reshape(old.shape) * np.int32(one))
            else:
                for b in rest:
                    self._refine(bits, p, b, start, end, one)

    @staticmethod
    def _refine(bits: _Bits, p: Component, b: int, k: int, end: int, one: int) -> None:
        at = k + np.flatnonzero(p.coef[b, k : end + 1])
        if len(at):
            c = p.coef[b, at]
            p.coef[b, at] = c + np.where(bits.block(len(at)), np.sign(c), 0) * one

    def planes(self) -> list[np.ndarray]:
        """Samples of each component at its own resolution, float32 around 128."""
        out = []
        for p in self.parts:
            blocks = (p.coef * self.quants[p.quant]) @ INVERSE + np.float32(128)
            out.append(blocks.reshape(-1, p.wide, 8, 8).swapaxes(1, 2).reshape(-1, p.wide * 8))
        return out

    def rgb(self) -> np.ndarray:
        """(height, width, 3) uint8."""
        full = []
        for p, plane in zip(self.parts, self.planes(), strict=True):
            plane = plane[: -(-self.height * p.v // self.vmax), : -(-self.width * p.h // self.hmax)]
            full.append(_upsampled(plane, self.vmax // p.v, self.hmax // p.h)[: self.height, : self.width])
        if len(full) == 1:
            grey = np.clip(np.rint(full[0]), 0, 255).astype(np.uint8)
            return np.repeat(grey[:, :, None], 3, axis=2)
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        parts = (y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)
        return np.clip(np.rint(np.stack(parts, axis=2)), 0, 255).astype(np.uint8)


def _doubled(a: np.ndarray) -> np.ndarray:
    """Twice as many rows: three parts of the nearer one, one part of the next."""
    around = np.concatenate([a[:1], a, a[-1:]])
    out = np.empty((2 * len(a), a.shape[1]), np.float32)
    out[::2], out[1::2] = 0.75 * a + 0.25 * around[:-2], 0.75 * a + 0.25 * around[2:]
    return out


def _upsampled(plane: np.ndarray, down: int, across: int) -> np.ndarray:
    if (down, across) == (1, 1):
        return plane
    if (plane == plane[0, 0]).all():  # one colour
        return np.full((len(plane) * down, plane.shape[1] * across), plane[0, 0], np.float32)
    plane = _doubled(plane) if down == 2 else plane.repeat(down, axis=0)
    return np.ascontiguousarray(_doubled(plane.T).T) if across == 2 else plane.repeat(across, axis=1)


# --- writing -----------------------------------------------------------------


def _segment(mark: int, body: bytes) -> bytes:
    return bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2, "big") + body


def _coded(bits: np.ndarray) -> bytes:
    fill = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(fill, np.uint8)]) if fill else bits).tobytes().replace(b"\xff", b"\xff\x00")


def _bits_of(value: int, n: int) -> list[int]:
    return [value >> i & 1 for i in range(n - 1, -1, -1)]


def _table(kind: int, ident: int, counts: list[int], symbols: list[int]) -> bytes:
    return bytes([kind << 4 | ident, *counts, *[0] * (16 - len(counts)), *symbols])


#: DC: difference 0 and the one-bit category. AC: symbol 01, and runs of ended bands of 2**r blocks.
_TABLES = _segment(0xC4, _table(0, 0, [1, 1], [0, 1]) + _table(1, 0, [1, 0, 0, 0, 15], [1, *[r << 4 for r in range(15)]]))
_RUN_CODE = {r: _bits_of(0b10000 + r, 5) for r in range(15)}
_QUANT = _segment(0xDB, bytes([0]) + bytes([1] * 64))


def _sides(blocks: int) -> tuple[int, int]:
    """Width and height in blocks: the payload fills rows; unused blocks at the end are zero bytes."""
    width = min(blocks, 64 if blocks <= 64 * MAX_SIDE else MAX_SIDE)
    return width, -(-blocks // width)


def _scan_head(ident: int, start: int, end: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([1, ident, 0, start, end, high << 4 | low]))


def write_payload(payload: bytes, chroma: bool = False) -> bytes:
    """A progressive JPEG whose luma coefficients are the payload's bytes + 256."""
    if not payload or len(payload) % 64:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    width, height = _sides(len(payload) // 64)
    if height > MAX_SIDE:
        raise ValueError("the payload is too large for one file")
    n = width * height
    values = np.zeros((n, 64), np.uint8)
    values.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    if chroma:
        comps = bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    else:
        comps = bytes([1, 1, 0x11, 0])
    frame = bytes([8]) + (height * 8).to_bytes(2, "big") + (width * 8).to_bytes(2, "big") + comps
    planes = np.unpackbits(values.reshape(-1, 1), axis=1)  # bit 7 first
    dc = planes.reshape(n, 64, 8)[:, 0]
    ac = planes.reshape(n, 64, 8)[:, 1:]
    out = [b"\xff\xd8", _QUANT, _segment(0xC2, frame), _TABLES]
    first = np.zeros(3 + n - 1, np.uint8)
    first[:3] = (1, 0, 1)  # category 1 (code 10), value 1, then no difference
    out += [_scan_head(1, 0, 0, 0, 8), _coded(first)]
    if chroma:
        for ident in (2, 3):
            out += [_scan_head(ident, 0, 0, 0, 0), _coded(np.zeros((-(-width // 2)) * (-(-height // 2)), np.uint8))]
    one = np.zeros((n * 63, 2), np.uint8)
    one[:, 1] = 1
    out += [_scan_head(1, 1, 63, 0, 8), _coded(one.reshape(-1))]
    for low in range(7, -1, -1):
        out += [_scan_head(1, 0, 0, low + 1, low), _coded(np.ascontiguousarray(dc[:, 7 - low]))]
        plane, parts = ac[:, :, 7 - low].reshape(n, 63), []
        at = 0
        while at < n:
            run = min(MAX_RUN, n - at)
            r = run.bit_length() - 1
            parts += [np.array(_RUN_CODE[r] + _bits_of(run - (1 << r), r), np.uint8), plane[at : at + run].reshape(-1)]
            at += run
        out += [_scan_head(1, 1, 63, low + 1, low), _coded(np.concatenate(parts))]
    return b"".join([*out, b"\xff\xd9"])


def read_payload(reader: ProgressiveReader, size: int) -> bytes:
    """The payload from the coefficients of the first component."""
    p = reader.parts[0]
    rows = p.coef.reshape(-1, p.wide, 64)[: p.blocks_h, : p.blocks_w].reshape(-1)[:size] - OFFSET
    if len(rows) < size or ((rows < 0) | (rows > 255)).any():
        raise ValueError("the file holds no payload of this size")
    return rows.astype(np.uint8).tobytes()


def padded(text: str | bytes | None) -> tuple[int, bytes]:
    data = text.encode() if isinstance(text, str) else text or b""
    size = max(64, -(-len(data) // 64) * 64)
    return len(data), data + bytes(size - len(data))


def features(rgb: np.ndarray) -> str:
    """Mean of each channel, and the mean of a 4 x 4 grid of luma-like means, as text."""
    h, w, _ = rgb.shape
    means = rgb.reshape(-1, 3).mean(axis=0)
    sums = np.add.reduceat(np.add.reduceat(rgb[:, :, 1].astype(np.float64), np.arange(4) * h // 4, axis=0), np.arange(4) * w // 4, axis=1)
    grid = sums * 16 / (h * w)
    return ",".join(f"{x:.3f}" for x in (*means, *grid.ravel()))


FIELDS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "height": pa.int32(), "width": pa.int32(), "rgb_crc32": pa.int64()}
MEDIA = "struct<" + ", ".join(f"{n}: { {pa.int64(): 'long', pa.int32(): 'int', pa.string(): 'string'}[k] }" for n, k in FIELDS.items()) + "{0}>"


def _media(tensors: bool):
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            n, payload = padded(text)
            stored = write_payload(payload, chroma=True)
            reader = ProgressiveReader(stored)
            back, rgb = read_payload(reader, len(payload)), reader.rgb()
            row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(rgb), *rgb.shape[:2], zlib.crc32(rgb.data))
            rows.append((*row, rgb.tobytes(), stored) if tensors else row)
        fields = FIELDS | ({"rgb": pa.binary(), "stored": pa.binary()} if tensors else {})
        cols = zip(*rows, strict=True) if rows else [[]] * len(fields)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, fields.values(), strict=True)], names=list(fields))

    return run


def text_media(docs: DataFrame, tensors: bool = False) -> DataFrame:
    """docs with the struct column ``__media``: each text stored as a file, read back and described; with ``tensors`` the RGB bytes and the file, too."""
    reserved(docs, "__media")
    tune(docs.sparkSession)
    return docs.withColumn("__media", F.arrow_udf(_media(tensors), MEDIA.format(", rgb: binary, stored: binary" if tensors else ""))(F.col("text").cast("binary")))


def _tensors(files: pa.Array) -> pa.Array:
    rows = []
    for data in files.to_pylist():
        rgb = ProgressiveReader(data).rgb() if data else np.zeros((0, 0, 3), np.uint8)
        rows.append((rgb.shape[0], rgb.shape[1], rgb.tobytes()))
    cols = zip(*rows, strict=True) if rows else [[]] * 3
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["height", "width", "rgb"])


def decode_images(table: DataFrame, column: str = "content", into: str = "tensor") -> DataFrame:
    """The table with full-resolution RGB tensors (height, width, rgb bytes) of a column of files; null gives 0 x 0."""
    tune(table.sparkSession)
    return table.withColumn(into, F.arrow_udf(_tensors, "struct<height: int, width: int, rgb: binary>")(F.col(column)))
