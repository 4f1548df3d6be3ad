"""Rows of alleles as bits: packed rows, run lengths and word-aligned codes, on NumPy arrays.

Storage is Parquet's business; these serve lines that are handed to others as bytes, and kernels.
"""

from __future__ import annotations

import numpy as np

#: Bits in a word behind its first, and the longest fill of a word.
GROUP, LONGEST = 15, (1 << 14) - 1
FILL, ONES = 1 << 15, 1 << 14


# packed rows (BIT-01): the first bit of a byte is its highest ------------------------------------------------------------


def pack(rows: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as bytes."""
    return np.packbits(rows.astype(bool), axis=-1)


def unpack(packed: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(packed, axis=-1, count=n)


def get(packed: np.ndarray, row: int | np.ndarray, column: int | np.ndarray) -> np.ndarray:
    column = np.asarray(column)
    return (packed[row, column >> 3] >> (7 - (column & 7)).astype(np.uint8)) & 1


def put(packed: np.ndarray, row: int, column: int, value: int) -> None:
    mask = np.uint8(128 >> (column & 7))
    packed[row, column >> 3] = packed[row, column >> 3] | mask if value else packed[row, column >> 3] & ~mask


def fill(packed: np.ndarray, row: int, value: int) -> None:
    packed[row] = 255 if value else 0


# run lengths (BIT-04, BIT-05, WIN-15) ------------------------------------------------------------------------------------


def run_lengths(row: np.ndarray) -> np.ndarray:
    """Lengths of the runs of equal values; the first is of zeros (and may be 0)."""
    if not len(row):
        return np.zeros(0, np.int64)
    cuts = np.flatnonzero(np.diff(row)) + 1
    lengths = np.diff(np.concatenate([[0], cuts, [len(row)]]))
    return np.concatenate([[0], lengths]) if row[0] else lengths


def encode_runs(row: np.ndarray) -> bytes:
    """Run lengths in groups of seven bits, low ones first; the high bit says that more follow."""
    lengths = run_lengths(row).astype(np.uint64)
    size = np.maximum(1, -(-np.where(lengths, np.floor(np.log2(np.maximum(lengths, 1))).astype(np.int64) + 1, 1) // 7))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[at[some] + k] = ((lengths[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def decode_runs(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, np.uint8)
    first = np.concatenate([[True], b[:-1] < 128])
    place = np.arange(len(b)) - np.maximum.accumulate(np.where(first, np.arange(len(b)), 0))
    lengths = np.add.reduceat((b & 127).astype(np.int64) << (7 * place), np.flatnonzero(first))
    return np.repeat((np.arange(len(lengths)) & 1).astype(np.uint8), lengths)


def advance(order: np.ndarray, alleles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BIT-05: the prefix order behind a site, those with 0 first, and how many of 0 stand before each place (one more at the end).

    order: haplotypes before the site; alleles: in that order, as decoded runs have them.
    """
    ones = alleles.astype(bool)
    return np.concatenate([order[~ones], order[ones]]), np.concatenate([[0], np.cumsum(~ones)])


# word-aligned codes (BIT-06): literals of GROUP bits and fills of equal groups -------------------------------------------------


def encode_words(row: np.ndarray) -> np.ndarray:
    """Bits as 16-bit words: a literal has GROUP bits, first bit highest; a fill has FILL, its value (ONES) and a count of groups."""
    groups = np.zeros(-(-len(row) // GROUP) * GROUP, dtype=np.int64)
    groups[: len(row)] = row
    values = groups.reshape(-1, GROUP) @ (1 << np.arange(GROUP - 1, -1, -1))
    full = (1 << GROUP) - 1
    plain = (values == 0) | (values == full)
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | ~plain[1:]
    start = np.flatnonzero(new)
    many, value, fills = np.diff(np.append(start, len(values))), values[start], plain[start]
    words = np.maximum(1, -(-many // LONGEST))  # a long fill takes several
    owner = np.repeat(np.arange(len(start)), words)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(words) - words, words)
    count = np.where(nth + 1 < words[owner], LONGEST, many[owner] - LONGEST * (words[owner] - 1))
    return np.where(fills[owner], FILL | np.where(value[owner] > 0, ONES, 0) | count, value[owner]).astype("<u2")


def _groups(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, how many groups it stands for and their value."""
    w = words.astype(np.int64)
    fills = w >= FILL
    return np.where(fills, w & LONGEST, 1), np.where(fills, np.where(w & ONES, (1 << GROUP) - 1, 0), w)


def decode_words(words: np.ndarray, n: int) -> np.ndarray:
    many, value = _groups(words)
    bits = (np.repeat(value, many)[:, None] >> np.arange(GROUP - 1, -1, -1)) & 1
    return bits.astype(np.uint8).ravel()[:n]


def count_ones(words: np.ndarray) -> int:
    """Without decoding; bits behind the row's end are zeros."""
    many, value = _groups(words)
    return int((np.bitwise_count(value) * many).sum())


def pull(words: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Bits start to stop: only the words that cover them are decoded."""
    many, _ = _groups(words)
    ends = np.cumsum(many) * GROUP
    a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
    before = int(ends[a - 1]) if a else 0
    return decode_words(words[a:b], int(many[a:b].sum()) * GROUP)[start - before : stop - before]
