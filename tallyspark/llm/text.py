"""Word spans and rolling word hashes of whole texts (numpy, used inside tasks).

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  All of these
bytes are ASCII, so working on UTF-8 bytes equals working on code points.
A word's hash is a polynomial over per-byte random values modulo 2**64, mixed
by a finaliser; a window's hash combines the hashes of its words with odd
multipliers and is mixed again.  Equal windows always have equal hashes; two
different windows share one with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(fold: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if fold:
        upper = (codes >= 65) & (codes <= 90)
        codes = np.where(upper, codes + np.uint64(32), codes)
    values = mix((codes + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    blank = np.arange(256)
    values[(blank == 32) | ((blank >= 9) & (blank <= 13))] = 0
    return values


_VALUES = {fold: _byte_values(fold) for fold in (False, True)}
_BLANK = _VALUES[False] == 0
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.ones(size, dtype=np.uint64)
            table[1:] = np.uint64(base)
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def word_starts(data: np.ndarray) -> np.ndarray:
    """Byte offsets at which words begin."""
    blank = _BLANK[data]
    begin = ~blank
    begin[1:] &= blank[:-1]
    return np.flatnonzero(begin)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words' begins and (exclusive) ends."""
    blank = _BLANK[data]
    begin, end = ~blank, ~blank
    begin[1:] &= blank[:-1]
    end[:-1] &= blank[1:]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _chunk_hashes(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    starts = word_starts(data)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = _power_tables(len(data))
    terms = values[data] * up[: len(data)]
    return mix(np.add.reduceat(terms, starts) * down[starts])


def word_hashes(text: bytes, fold: bool = False) -> np.ndarray:
    """One 64-bit hash per word, in text order; ``fold`` lower-cases A-Z first.

    Texts are worked through in pieces cut at white space, so memory stays a
    small multiple of the text.
    """
    data = np.frombuffer(text, dtype=np.uint8)
    values = _VALUES[fold]
    if len(data) <= _CHUNK:
        return _chunk_hashes(data, values)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        while end < len(data):
            gap = np.flatnonzero(_BLANK[data[end:end + _CHUNK]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + _CHUNK)
        out.append(_chunk_hashes(data[at:end], values))
        at = end
    return np.concatenate(out)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive words (none if there are fewer words)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    factor = 1
    for i in range(width):
        factor = factor * 0x5851F42D4C957F2D & _MASK
        total += words[i:i + n] * np.uint64(factor | 1)
    return mix(total + np.uint64(width))


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending (``numpy.unique`` takes several times as long for some hundreds of integers)."""
    values = np.sort(values)
    first = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the A-Z-folded ``width``-word shingles.

    A text of fewer words is one shingle (its whole word sequence); one without
    words has none.
    """
    if not text:
        return np.empty(0, dtype=np.uint64)
    words = word_hashes(text, fold=True)
    if not len(words):
        return words
    return sorted_distinct(window_hashes(words, min(width, len(words))))


def texts_of(column) -> list[bytes]:
    """An Arrow string column's values as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]


def pieces(batches, rows: int = 512):
    """Arrow batches cut into smaller ones, so that what a task derives from one stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def small_batches(spark) -> None:
    """Hand rows to Python tasks in batches of 2000, so that batches of whole texts stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
