"""Words of texts inside Arrow tasks: fast byte-level splitting, stable 64-bit hashes and shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: A-Z fall to lower case; every ASCII character other than digits and letters separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and non-ASCII characters, in UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class WordHashes(dict):
    """A word's 64-bit hash, computed once; emptied at ``most`` entries so that a task's memory stays bounded."""

    def __init__(self, most: int = 150_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """The hash of each ``width`` consecutive words; of all words, if there are fewer; none of none."""
    n = len(hashes) - width + 1
    if n < 1:
        n, width = min(1, len(hashes)), len(hashes)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mixed(out * _ODD + hashes[k : k + n])
    return out


def columns(batches: Iterator[pa.RecordBatch], *names: str, rows: int = 512) -> Iterator[list[list]]:
    """The named columns as Python lists, of some rows at a time, so that a batch is never held twice."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            part = batch.slice(begin, rows)
            yield [part.column(part.schema.get_field_index(name)).to_pylist() for name in names]


def runs_of_shingles(hashes: np.ndarray, starts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of many texts at once, given as runs of word hashes from their starts on, each of ``width`` words at least; and where each text's begin."""
    grams = shingles(hashes, width)
    inside = np.ones(len(grams), bool)
    for k in range(1, width):
        inside[starts[1:] - k] = False
    sizes = np.diff(np.append(starts, len(hashes))) - width + 1
    return grams[inside], np.cumsum(sizes) - sizes


def distinct_sizes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many different values each run has."""
    owner = np.repeat(np.arange(len(starts), dtype=np.uint64), np.diff(np.append(starts, len(values))))
    key = mixed(values ^ mixed(owner + _ODD))
    order = np.argsort(key)
    first = np.append(True, key[order][1:] != key[order][:-1])
    return np.bincount(owner[order][first].astype(np.int64), minlength=len(starts))


def sketch(registers: np.ndarray, planes: int = 4) -> np.ndarray:
    """Of each row of 64-bit registers: ``planes`` planes of words, with a bit of a hash of each register in each plane."""
    n, m = registers.shape
    words = -(-m // 64)
    hashed = mixed(registers ^ _ODD)
    out = np.zeros((n, planes, words), np.uint64)
    for p in range(planes):
        bits = (hashed >> np.uint64(p)) & np.uint64(1)
        for w in range(words):
            part = bits[:, 64 * w : 64 * w + 64]
            out[:, p, w] = (part << np.arange(part.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out.reshape(n, planes * words)


def list_column(rows: np.ndarray) -> pa.Array:
    """Rows of 64-bit values as a column of lists of bigint."""
    n, m = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m), pa.int32()), pa.array(rows.reshape(-1).view(np.int64)))
