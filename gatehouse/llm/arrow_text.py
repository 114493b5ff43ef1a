"""Vectorised text helpers for tasks: Arrow string columns as byte blocks, tokens and token hashes in numpy.

A block is a run of whole texts of about a megabyte, so memory stays bounded however long a batch is; a longer text is
a block of its own. Positions are byte positions inside the block.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Ship these functions with the task, so that workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 1 << 20

_CODES = np.arange(256)
_UPPER = (_CODES >= 0x41) & (_CODES <= 0x5A)
#: Lower-cases A-Z only, byte by byte.
LOWER = np.where(_UPPER, _CODES + 32, _CODES).astype(np.uint8)
#: Bytes of words: digits, letters and everything beyond ASCII.
WORD = ((_CODES >= 0x30) & (_CODES <= 0x39)) | _UPPER | ((_CODES >= 0x61) & (_CODES <= 0x7A)) | (_CODES >= 0x80)
#: Bytes of tokens: everything but the blank and 0x09 to 0x0D.
TOKEN = ~((_CODES == 0x20) | ((_CODES >= 0x09) & (_CODES <= 0x0D)))


class Block(NamedTuple):
    """Whole texts ``first`` to ``first + count`` of a column, as bytes."""

    first: int
    count: int
    data: np.ndarray
    offsets: np.ndarray


class Tokens(NamedTuple):
    """Byte spans of the tokens of a block; text i has tokens ``bounds[i]`` to ``bounds[i + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a string column; a null counts as an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield Block(first, last - first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def tokens(block: Block, member: np.ndarray) -> Tokens:
    """Maximal runs of member bytes, cut at text ends."""
    inside = member[block.data]
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
    text_starts = block.offsets[:-1][block.offsets[:-1] < len(inside)]
    before[text_starts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    if len(inside):
        after[-1] = False
        after[:-1] = inside[1:]
    text_ends = block.offsets[1:][block.offsets[1:] > 0] - 1
    after[text_ends] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Tokens(starts, ends, np.searchsorted(starts, block.offsets))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    size = max(_POWERS, default=0)
    if size < length:
        size = max(length, BLOCK_BYTES + 1)
        both = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        if size > 16 * BLOCK_BYTES:
            return both[0], both[1]
        _POWERS.clear()
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; equal bytes have equal hashes in every task."""
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_LETTER[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a block and the bounds of each text's words."""
    found = tokens(block, WORD)
    return span_hashes(LOWER[block.data], found.starts, found.ends), found.bounds
