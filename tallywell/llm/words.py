"""Words of whole texts as 64-bit hashes, for a batch of documents at a time.

A batch of texts is one byte buffer. Word boundaries come from a table of 256 entries, and the hash of every word from
one running sum: bytes are weighted with powers of an odd number modulo 2**64, so a word's hash is a difference of two
sums, shifted to the word's start. No Python code runs per word. Memory is bounded by SLICE, not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_STEP = np.random.default_rng(20240607).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Blank, marked 1: space and \t \n \v \f \r. Everything else belongs to a word.
BLANK = bytes(int(i in (9, 10, 11, 12, 13, 32)) for i in range(256))
#: Not of a word: all of ASCII but digits and letters; bytes of other characters belong to words.
NOT_ALPHANUMERIC = bytes(int(i < 128 and not chr(i).isalnum()) for i in range(256))


def mix(values: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over all bits."""
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least `size` of them."""
    length = max(SLICE * 2, 1 << (size - 1).bit_length())
    if length not in _powers:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.ones(length, np.uint64)
            done = 1
            while done < length:
                table[done : 2 * done] = table[:done] * np.uint64(pow(base, done, 1 << 64))
                done *= 2
            tables.append(table)
        if length > SLICE * 2:
            return tables[0], tables[1]
        _powers[length] = (tables[0], tables[1])
    return _powers[length]


def _slice_words(data: bytes, outside: bytes, prefixes: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Hash, first byte, end of each word; then for each length the hash of the word's first bytes, 0 if it has fewer."""
    inside = np.frombuffer(data.translate(outside), np.int8) == 0
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    weighted = np.frombuffer(data, np.uint8).astype(np.uint64)
    weighted *= power[: len(data)]
    np.cumsum(weighted, out=sums[1:])

    def hashed(upto: np.ndarray) -> np.ndarray:
        return mix((sums[upto] - sums[starts]) * inverse[starts] + (upto - starts).astype(np.uint64))

    heads = [np.where(starts + n <= ends, hashed(np.minimum(starts + n, ends)), np.uint64(0)) for n in prefixes]
    return hashed(ends), starts, ends, *heads


def word_hashes(texts: list[bytes], outside: bytes = BLANK, places: bool = False, prefixes: tuple[int, ...] = ()):
    """Hashes of the words of all texts in order, and the first word of each text (one more entry: the end).

    With `places`, also each word's first byte and the byte after its last, counted within its own text. With
    `prefixes`, also for each of these lengths the hash of the word's first bytes, as if they were a word, or 0.
    """
    buffer = b" ".join(texts) + b" "
    offsets = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * len(prefixes))]
    at = 0
    while texts and at < len(buffer):
        end = min(at + SLICE, len(buffer))
        while end < len(buffer) and not outside[buffer[end - 1]]:  # never cut a word
            end += 1
        found, starts, ends, *heads = _slice_words(buffer[at:end], outside, prefixes)
        parts.append((found, starts + at, ends + at, *heads))
        at = end
    found, starts, ends, *heads = (np.concatenate(column) for column in zip(*parts))
    bounds = np.searchsorted(starts, offsets)
    base = np.repeat(offsets[:-1], np.diff(bounds))
    return found, bounds, *((starts - base, ends - base) if places else ()), *heads


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, texts not told apart: entry i starts at word i."""
    count = max(0, len(words) - size + 1)
    total = np.zeros(count, np.uint64)
    for j in range(size):
        total += words[j : j + count] * _STEP[j]
    return mix(total)


def owner_of(bounds: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def shingle_sets(words: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of `size` words; a shorter text is one run, an empty one has none."""
    grams = gram_hashes(words, size)
    sets = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        count = high - low
        if count >= size:
            found = np.sort(grams[low : high - size + 1])
            sets.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif count:
            sets.append(mix((words[low:high] * _STEP[32 : 32 + count]).sum(keepdims=True, dtype=np.uint64) + np.uint64(count)))
        else:
            sets.append(words[:0])
    return sets


def chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about `limit` bytes together; a longer text is a range of its own."""
    begin = total = 0
    for at, text in enumerate(texts):
        if total and total + len(text) > limit:
            yield begin, at
            begin, total = at, 0
        total += len(text) + 1
    if texts:
        yield begin, len(texts)


def as_bytes(column) -> list[bytes]:
    """The texts of an Arrow column in UTF-8; a null counts as empty."""
    return [text or b"" for text in column.cast(pa.binary()).to_pylist()]
