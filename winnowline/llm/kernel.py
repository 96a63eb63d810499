"""Vectorised text kernels for Arrow batches inside tasks: words, word hashes, shingles."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa

U64 = np.uint64


def trim() -> None:
    """Give freed memory back to the system: a worker lives on, and two share an executor with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(f):
    """f, with memory given back after each group."""

    def run(*arguments) -> pa.Table:
        out = f(*arguments)
        trim()
        return out

    return run


CHUNK = 1 << 19


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.cast(pa.large_string())
    if a.null_count:
        a = a.fill_null("")
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def utf8_bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large binary array without nulls."""
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, np.int64)[a.offset : a.offset + len(a) + 1]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def pack_six(x: np.ndarray) -> bytes:
    """Integers below 2^48 in six bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size says, one behind the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(is a space, the byte with A-Z in lower case)."""
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return space, lower


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BASE = 0x9E3779B97F4A7C15


@functools.cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    with np.errstate(over="ignore"):
        up, down = np.full(n, U64(BASE)), np.full(n, U64(pow(BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


@functools.cache
def byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for ascending spans: polynomials from running sums, chunk by chunk."""
    out, i, n = np.empty(len(starts), U64), 0, len(starts)
    codes = byte_codes()
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        size = 1 << max(19, int(b - a).bit_length())
        up, down = powers(size)
        sums = np.empty(b - a + 1, U64)
        sums[0] = 0
        np.cumsum(codes[data[a:b]] * up[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
        i = j
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of all words; a text's end also ends its last word."""
    space, _ = tables()
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    blank = np.empty(n + 1, bool)
    np.take(space, data, out=blank[:n])
    blank[n] = True
    begin = ~blank[:n]
    begin[1:] &= blank[: n - 1]
    cut = offsets[:-1][np.diff(offsets) > 0]
    begin[cut] = ~blank[cut]
    finish = ~blank[:n] & blank[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    finish[last] = ~blank[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(column, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lowered, offsets by text into it)."""
    data, offsets = utf8(column)
    starts, ends, doc = word_spans(data, offsets)
    if lower:
        data = tables()[1][data]
    bounds = np.searchsorted(doc, np.arange(len(offsets)), side="left")
    return span_hashes(data, starts, ends), bounds


def shingle_sets(column, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles; of all its words, if they are fewer."""
    words, bounds = word_hashes(column)
    multipliers = mix(np.arange(11, 11 + width, dtype=U64))
    m = len(words)
    full = np.zeros(max(0, m - width + 1), U64)
    for k in range(width):
        full += words[k : m - width + 1 + k] * multipliers[k] if m >= width else 0
    full = mix(full)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            s = np.sort(full[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            short = np.array([(words[a:b] * multipliers[: b - a]).sum(dtype=U64)])
            out.append(mix(short + U64((b - a) * 0x165667B19E3779F9 & 0xFFFFFFFFFFFFFFFF)))
        else:
            out.append(np.zeros(0, U64))
    return out
