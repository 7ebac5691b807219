"""A bounded filter for keys that occur at least twice (two-pass Bloom filtering).

Every cell holds two bits: seen, and seen again.  A key sets one cell in each of
``hashes`` regions; it is *possibly repeated* when all its cells were seen
again.  A repeated key always passes; a unique one passes only by collision.

The filter is built by Spark: each task folds its keys into sorted cell lists,
split into fixed chunks; a reduce by chunk merges them into dense bit maps as
they stream by, so no task holds more than its own chunks.  The number of cells
grows with the keys up to ``max_bits`` (2**28 cells: a 32 MB map, the proven
bound of what is broadcast).  Beyond that load the map only lets more unique
keys pass; users of the filter stay exact at any load.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame

CHUNK_BITS = 19
_FLUSH = 1 << 21
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def cells_of(keys: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """Cell numbers, shape (hashes, keys); every hash has a region of 2**bits cells."""
    keys = keys.view(np.uint64)
    out = np.empty((hashes, len(keys)), dtype=np.int64)
    for i in range(hashes):
        x = keys * np.uint64(_ODD[i])
        x ^= x >> np.uint64(29)
        x = x * np.uint64(_ODD[(i + 1) % len(_ODD)])
        out[i] = (x >> np.uint64(64 - bits)).astype(np.int64) + (i << bits)
    return out


def _chunks(cells: np.ndarray):
    """(chunk, offsets seen, offsets seen again) of the cells of one flush."""
    cell, count = np.unique(cells, return_counts=True)
    cuts = np.flatnonzero(np.diff(cell >> CHUNK_BITS)) + 1
    for part, n in zip(np.split(cell, cuts), np.split(count, cuts), strict=True):
        if len(part):
            low = (part & ((1 << CHUNK_BITS) - 1)).astype(np.uint32)
            yield int(part[0] >> CHUNK_BITS), low.tobytes(), low[n > 1].tobytes()


def fold_keys(parts, bits: int, hashes: int):
    """Cell lists of an iterator of key arrays, flushed at a bounded number of cells."""
    held, size = [], 0
    for keys in parts:
        for at in range(0, len(keys), _FLUSH):
            held.append(cells_of(keys[at:at + _FLUSH], bits, hashes).ravel())
            size += len(held[-1])
            if size >= _FLUSH:
                yield from _chunks(np.concatenate(held))
                held, size = [], 0
    if size:
        yield from _chunks(np.concatenate(held))


def _bits(offsets: bytes) -> np.ndarray:
    out = np.zeros(1 << CHUNK_BITS, dtype=bool)
    out[np.frombuffer(offsets, dtype=np.uint32)] = True
    return np.packbits(out)


def _start(v):
    return _bits(v[0]), _bits(v[1])


def _merge(a, b):
    return a[0] | b[0], a[1] | b[1] | (a[0] & b[0])


def _add(a, v):
    return _merge(a, _start(v))


def region_bits(n_keys: int, max_bits: int = 28, hashes: int = 2) -> int:
    """log2 of the cells of one hash's region: four to eight for a key, within the bound."""
    room = max_bits - (hashes - 1).bit_length()
    return int(min(room, max(CHUNK_BITS, int(max(n_keys, 1) * 4).bit_length())))


class RepeatFilter:
    """The broadcast maps of cells seen and seen again, with the tests tasks apply."""

    def __init__(self, maps: Broadcast, bits: int, hashes: int):
        self.maps, self.bits, self.hashes = maps, bits, hashes

    def drop(self) -> None:
        """Free the maps, on the executors too, once nothing reads them any more."""
        self.maps.destroy()

    def _all_set(self, which: int, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, dtype=bool)
        packed = self.maps.value[which]
        out = np.ones(len(keys), dtype=bool)
        for cells in cells_of(keys, self.bits, self.hashes):
            out &= ((packed[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).astype(bool)
        return out

    def maybe_seen(self, keys: np.ndarray) -> np.ndarray:
        """True for every key that occurs, false for most others (only if built with ``keep_seen``)."""
        return self._all_set(0, keys)

    def maybe_repeated(self, keys: np.ndarray) -> np.ndarray:
        """True for every key that occurs twice or more, false for nearly all others."""
        return self._all_set(1, keys)


def build(df: DataFrame, key_arrays, n_keys: int, max_bits: int = 28, hashes: int = 2,
          keep_seen: bool = False) -> RepeatFilter:
    """The filter over all keys of ``df``.

    ``key_arrays(batch)`` yields the integer key arrays of one Arrow batch;
    ``n_keys`` (about how many there are) only sets the number of cells.
    """
    spark = df.sparkSession
    bits = region_bits(n_keys, max_bits, hashes)

    def fold(batches):
        import pyarrow as pa

        for chunk, seen, again in fold_keys((k for b in batches for k in key_arrays(b)), bits, hashes):
            yield pa.RecordBatch.from_pydict(
                {"chunk": pa.array([chunk], pa.int32()), "seen": pa.array([seen], pa.binary()),
                 "again": pa.array([again], pa.binary())})

    n_chunks = max(1, hashes << bits >> CHUNK_BITS)
    pieces = df.mapInArrow(fold, "chunk int, seen binary, again binary")
    merged = (pieces.rdd.map(lambda r: (r.chunk, (bytes(r.seen), bytes(r.again))))
              .combineByKey(_start, _add, _merge, min(n_chunks, 16))
              .mapValues(lambda v: (v[0].tobytes() if keep_seen else None, v[1].tobytes() if v[1].any() else None)))
    size, width = (hashes << bits) // 8, (1 << CHUNK_BITS) // 8
    maps = [np.zeros(size if which or keep_seen else 0, dtype=np.uint8) for which in (0, 1)]
    for chunk, found in merged.collect():  # at most max_bits / 8 bytes a map in all
        for into, data in zip(maps, found, strict=True):
            if data is not None:
                into[chunk * width:(chunk + 1) * width] = np.frombuffer(data, dtype=np.uint8)
    return RepeatFilter(spark.sparkContext.broadcast(maps), bits, hashes)
