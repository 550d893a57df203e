"""Chunk codecs: raw, gzip, zstd, Blosc containers, and range ANS."""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np

# constants of the rANS format: fixed values
SCALE_BITS, LOW = 12, 1 << 23
BLOSC_INNER = ("blosclz", "lz4", "snappy", "zlib", "zstd")


def decompress(codec: str | None, data: bytes, size: int | None = None) -> bytes:
    """Decode a chunk; "zstd" also accepts a Blosc container."""
    if codec in (None, "raw", "bytes"):
        return data
    if codec in ("gzip", "zlib"):
        return zlib.decompress(data, 47)
    if codec == "zstd" and data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if codec in ("zstd", "blosc"):
        return blosc_decode(data)
    raise ValueError(f"unknown codec {codec}")


def compress(codec: str | None, data: bytes) -> bytes:
    if codec in (None, "raw", "bytes"):
        return data
    if codec in ("gzip", "zlib"):
        return gzip.compress(data, 5, mtime=0) if codec == "gzip" else zlib.compress(data)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=3).compress(data)
    raise ValueError(f"cannot write codec {codec}")


def unshuffle(data: bytes, width: int) -> bytes:
    """Undo Blosc's byte shuffle; bytes after the last whole element stay."""
    n = len(data) // width
    body = np.frombuffer(data[: n * width], np.uint8).reshape(width, n).T
    return body.tobytes() + data[n * width :]


def _inner(kind: str, data: bytes, size: int) -> bytes:
    if kind == "lz4":
        import pyarrow as pa

        return pa.Codec("lz4_raw").decompress(data, size).to_pybytes()
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    if kind == "zlib":
        return zlib.decompress(data)
    raise ValueError(f"Blosc inner codec {kind} is not supported")


def blosc_decode(data: bytes) -> bytes:
    """Decode a Blosc 1 container: 16-byte header, block offsets, streams with their lengths in front."""
    _, _, flags, width, size, block, _ = struct.unpack("<BBBBIII", data[:16])
    if flags & 2:
        return data[16 : 16 + size]
    kind, shuffled, split = BLOSC_INNER[flags >> 5], flags & 1, not flags & 16
    out = []
    for k, at in enumerate(struct.unpack(f"<{-(-size // block)}I", data[16 : 16 + 4 * -(-size // block)])):
        n = min(block, size - k * block)
        parts = width if split and n == block and width <= 16 and n // width >= 128 else 1
        got = []
        for _ in range(parts):
            (length,) = struct.unpack("<i", data[at : at + 4])
            piece = data[at + 4 : at + 4 + length]
            got.append(piece if length == n // parts else _inner(kind, piece, n // parts))
            at += 4 + length
        whole = b"".join(got)
        out.append(unshuffle(whole, width) if shuffled and width > 1 else whole)
    return b"".join(out)


def blosc_encode(data: bytes, width: int, block: int = 1 << 18) -> bytes:
    """A Blosc 1 container of shuffled, unsplit zstd blocks; a block that does not shrink is stored as it is."""
    import zstandard

    kind, blocks = BLOSC_INNER.index("zstd"), []
    block = max(width, block // width * width)
    for at in range(0, len(data), block):
        part = data[at : at + block]
        n = len(part) // width
        mixed = np.frombuffer(part[: n * width], np.uint8).reshape(n, width).T.tobytes() + part[n * width :] if width > 1 else part
        code = zstandard.ZstdCompressor(level=1).compress(mixed)
        code = code if len(code) < len(mixed) else mixed
        blocks.append(struct.pack("<i", len(code)) + code)
    first = 16 + 4 * len(blocks)
    starts = np.cumsum([first, *map(len, blocks)]).tolist()
    flags = kind << 5 | 16 | 1
    return struct.pack("<BBBBIII", 2, 1, flags, width, len(data), block, starts[-1]) + struct.pack(f"<{len(blocks)}I", *starts[:-1]) + b"".join(blocks)


#: The first bytes of a coded chunk of floats: a fixed value of the format.
CHUNK_MARK = b"C4DR"


def chunk_encode(values: np.ndarray) -> bytes:
    """Floats as residuals whose step follows their largest size: mark, number, step, code."""
    a = np.asarray(values, float).ravel()
    step = float(np.float32(np.abs(a).max(initial=0.0) / 127 or 1.0))
    return CHUNK_MARK + struct.pack("<If", a.size, step) + residual_encode(a, step)


def chunk_decode(data: bytes) -> np.ndarray:
    if data[:4] != CHUNK_MARK:
        raise ValueError("not a coded chunk")
    n, step = struct.unpack("<If", data[4:12])
    return residual_decode(data[12:], n, step)


def frequencies(data: bytes) -> np.ndarray:
    """Symbol frequencies normalised to 2**12; each symbol that occurs keeps at least 1."""
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.int64)
    if not n.sum():
        return n
    f = np.where(n > 0, np.maximum(1, n * (1 << SCALE_BITS) // n.sum()), 0)
    while (off := (1 << SCALE_BITS) - f.sum()) != 0:
        k = int(np.argmax(f))
        f[k] += off if off > 0 else max(off, 1 - f[k])
    return f


def rans_encode(data: bytes, f: np.ndarray) -> bytes:
    """Range ANS of bytes under ``f``: state in 4 bytes, then the stream."""
    start = np.concatenate([[0], np.cumsum(f)[:-1]]).tolist()
    freq, x, out = f.tolist(), LOW, bytearray()
    for s in reversed(data):
        top = ((LOW >> SCALE_BITS) << 8) * freq[s]
        while x >= top:
            out.append(x & 255)
            x >>= 8
        x = ((x // freq[s]) << SCALE_BITS) + x % freq[s] + start[s]
    return struct.pack("<I", x) + bytes(reversed(out))


def rans_decode(data: bytes, f: np.ndarray, n: int) -> bytes:
    start = np.concatenate([[0], np.cumsum(f)[:-1]]).tolist()
    freq, symbol = f.tolist(), np.repeat(np.arange(256), f).tolist()
    (x,), at, out, mask = struct.unpack("<I", data[:4]), 4, bytearray(n), (1 << SCALE_BITS) - 1
    for i in range(n):
        low = x & mask
        s = symbol[low]
        out[i] = s
        x = freq[s] * (x >> SCALE_BITS) + low - start[s]
        while x < LOW and at < len(data):
            x = (x << 8) | data[at]
            at += 1
    return bytes(out)


def residual_encode(values: np.ndarray, scale: float) -> bytes:
    """Quantised residuals (half away from zero, clamped to +-127) with their frequency table in front."""
    q = np.clip(np.sign(values) * np.floor(np.abs(values) / scale + 0.5), -127, 127)
    data = (q + 128).astype(np.uint8).tobytes()
    f = frequencies(data)
    return f.astype("<u2").tobytes() + rans_encode(data, f)


def residual_decode(data: bytes, n: int, scale: float) -> np.ndarray:
    f = np.frombuffer(data[:512], "<u2").astype(np.int64)
    return (np.frombuffer(rans_decode(data[512:], f, n), np.uint8).astype(float) - 128) * scale


def lanczos_upsample(a: np.ndarray) -> np.ndarray:
    """Separable two-fold Lanczos-3 upsampling; edges repeat."""
    for k in range(a.ndim):
        n = a.shape[k]
        x = (np.arange(2 * n) + 0.5) / 2 - 0.5
        base = np.floor(x).astype(int)
        out, total = 0.0, 0.0
        for t in range(-2, 4):
            d = x - (base + t)
            w = np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0.0)
            shape = [1] * a.ndim
            shape[k] = 2 * n
            out = out + w.reshape(shape) * np.take(a, np.clip(base + t, 0, n - 1), k)
            total = total + w.reshape(shape)
        a = out / total
    return a


def pyramid_encode(levels: list[np.ndarray], scale: float) -> list[bytes]:
    """Coarsest level first; finer ones as residuals against the upsampled decoded coarser level."""
    out, seen = [], None
    for a in reversed(levels):
        guess = np.zeros(a.shape) if seen is None else lanczos_upsample(seen)[tuple(slice(0, n) for n in a.shape)]
        code = residual_encode((a - guess).ravel(), scale if seen is not None else max(scale, float(np.abs(a).max(initial=0)) / 127 or scale))
        s = scale if seen is not None else max(scale, float(np.abs(a).max(initial=0)) / 127 or scale)
        seen = guess + residual_decode(code, a.size, s).reshape(a.shape)
        out.append(struct.pack("<d", s) + code)
    return out


def pyramid_decode(codes: list[bytes], shapes: list[tuple]) -> list[np.ndarray]:
    """Levels, coarsest first, of ``pyramid_encode`` with their shapes in the same order."""
    out: list[np.ndarray] = []
    for code, shape in zip(codes, shapes, strict=True):
        (s,) = struct.unpack("<d", code[:8])
        guess = np.zeros(shape) if not out else lanczos_upsample(out[-1])[tuple(slice(0, n) for n in shape)]
        out.append(guess + residual_decode(code[8:], int(np.prod(shape)), s).reshape(shape))
    return out
