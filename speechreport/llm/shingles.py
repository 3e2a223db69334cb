"""Word shingles of whole texts as sorted distinct 64-bit hashes, for Arrow batch tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

WORDS = 5
#: Rows of a batch that a task takes at once, and bytes that are hashed at a time.
SLICE, BLOCK = 256, 1 << 20
#: Odd multipliers, one for each place in a shingle, and those of a 64-bit finalizer.
PLACE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
BLANKS = np.isin(np.arange(256), [*range(9, 14), 32])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


#: A number for each byte, and powers of an odd number and of its inverse for each place in a block.
LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(PLACE[0]))
POWERS, INVERSES = (np.cumprod(np.full(BLOCK, x % 2**64, np.uint64)) for x in (PLACE[1], pow(PLACE[1], -1, 2**64)))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word between ASCII white space; data ends with white space.

    A word's hash is a polynomial of its bytes, taken from running sums over a block of whole words. Words
    that fill a block are hashed by themselves.
    """
    found, starts, at, whole = [], [], 0, np.frombuffer(data, np.uint8)
    while at < len(data):
        x = whole[at : at + BLOCK]
        blank = BLANKS[x]
        if len(x) == BLOCK and not blank[-1]:
            cut = BLOCK - int(np.argmax(blank[::-1]))
            if cut == BLOCK:  # no white space
                more = np.flatnonzero(BLANKS[whole[at:]])[0]
                found.append(np.array([xxhash.xxh3_64_intdigest(data[at : at + more])], np.uint64))
                starts.append(np.array([at]))
                at += int(more)
                continue
            x, blank = x[:cut], blank[:cut]
        edges = np.flatnonzero(np.diff(blank, prepend=True))
        begin, end = edges[::2], edges[1::2]
        sums = np.cumsum(LETTERS[x] * POWERS[: len(x)])
        before = np.where(begin > 0, sums[begin - 1], np.uint64(0))
        found.append(mixed((sums[end - 1] - before) * INVERSES[begin] + (end - begin).astype(np.uint64)))
        starts.append(begin + at)
        at += len(x)
    return (np.concatenate(found), np.concatenate(starts)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    return shingle_sets([text], n)[0]


def shingle_sets(texts: list[str | None], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text, A-Z in lower case.

    A text with fewer words is one shingle; without words there is none. (bytes.lower() changes lower ASCII
    letters alone.) A shingle's hash is a sum of its words' hashes, each times a multiplier of its place, and is taken
    over all texts at once.
    """
    told = [(t or "").encode() for t in texts]
    h, starts = word_hashes(b" ".join([*told, b""]).lower())
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in told]))
    sizes = np.diff(ends, prepend=0)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    total = np.full(len(h), n, np.uint64)
    for k in range(n):
        total += padded[k : len(h) + k] * np.uint64(PLACE[k % len(PLACE)] + 2 * (k // len(PLACE)))
    total = mixed(total)
    found = []
    for size, end in zip(sizes.tolist(), ends.tolist(), strict=True):
        if size >= n:
            found.append(np.unique(total[end - size : end - n + 1]))
        elif size:
            short = size
            for k, x in enumerate(h[end - size : end].tolist()):
                short = (short + x * PLACE[k % len(PLACE)]) % 2**64
            found.append(mixed(np.array([short], np.uint64)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def portions(texts: list[str | None], size: int = 1 << 20) -> list[slice]:
    """Slices of a list of texts with about ``size`` characters each."""
    found, begin, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= size or i == len(texts) - 1:
            found.append(slice(begin, i + 1))
            begin, held = i + 1, 0
    return found


def all_sets(texts: list[str | None], n: int = WORDS) -> list[np.ndarray]:
    """shingle_sets() portion by portion, for batches of any size."""
    return [s for part in portions(texts) for s in shingle_sets(texts[part], n)]


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of SLICE rows, so that a task holds few texts and sets at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)
