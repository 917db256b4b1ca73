"""Word rules that several operators share, and hashed word sequences.

Words are cut from UTF-8 bytes: ``bytes.split`` splits at exactly the
characters 0x20 and 0x09 to 0x0D, and ``bytes.lower`` lowers A-Z alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes that end a letter-or-digit word: all ASCII but 0-9, A-Z and a-z.
_PLAIN = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))

STEP = np.uint64(0x9E3779B97F4A7C15)


def space_words(text: str | None, lower: bool = False) -> list[bytes]:
    if text is None:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of a-z, 0-9 and non-ASCII characters."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().translate(_PLAIN).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, size: int, step: np.uint64 = STEP) -> np.ndarray:
    """Polynomial hash of each run of ``size`` values: sum of h[i+j] * step^j."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total, at, power, width, block = np.zeros(n, np.uint64), 0, np.uint64(1), 1, h
        while True:
            if size & width:
                total += block[at : at + n] * power
                at, power = at + width, power * step ** np.uint64(width)
            if 2 * width > size:
                return total
            block = block[: len(block) - width] + block[width:] * (step ** np.uint64(width))
            width *= 2


def chunks(batches: Iterator[pa.RecordBatch], text: str, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches at about ``size`` bytes of text; a longer text stands alone."""
    for batch in batches:
        offsets = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(offsets), 0
        while begin < len(batch):
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(begin, end - begin)
            begin = end
