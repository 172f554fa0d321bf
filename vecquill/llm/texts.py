"""What the text operators share: batches of texts as one array of code
points, and hashes of all windows of a length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multipliers of two polynomial hashes, modulo 2**64.
BASE, OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of non-null texts, one text after the other, and where
    each begins (one entry more than there are texts)."""
    parts = [t.encode("utf-32-le", "surrogatepass") for t in texts.to_pylist()]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) // 4 for p in parts], out=starts[1:])
    return np.frombuffer(b"".join(parts), "<u4"), starts


def spread(codes: np.ndarray) -> np.ndarray:
    """Code points as well-mixed 64-bit numbers."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def power(n: int, base: int = BASE) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def joined(left: np.ndarray, right: np.ndarray, right_length: int, base: int = BASE) -> np.ndarray:
    """Hashes of the concatenation of windows with these hashes."""
    return left * power(right_length, base) + right


def windows(letters: np.ndarray, length: int, base: int = BASE) -> np.ndarray:
    """Hashes of all windows of ``length`` letters, by repeated doubling."""
    n = len(letters)
    if n < length:
        return np.zeros(0, np.uint64)
    out, done = None, 0
    cur, size = letters, 1
    while True:
        if length & size:
            if out is None:
                out, done = cur, size
            else:
                m = n - (done + size) + 1
                out = joined(cur[:m], out[size : size + m], done, base)
                done += size
        if done == length:
            return out[: n - length + 1]
        m = n - 2 * size + 1
        cur = joined(cur[:m], cur[size : size + m], size, base)
        size *= 2


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. count - 1 for each count, one after the other."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts, counts)


def slices(batch: pa.RecordBatch, column: int, letters: int = 1 << 19):
    """Parts of a batch with about ``letters`` bytes of text each, at least
    one row."""
    sizes = np.array([0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()], np.int64)
    total = np.cumsum(sizes)
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + letters, "right"))
        end = max(end, begin + 1)
        yield batch.slice(begin, end - begin)
        begin = end
